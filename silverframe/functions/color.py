"""Pixel operators as column arithmetic over (r, g, b) from 0 to 1; truth is double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from silverframe.functions.scalars import clamp, let, mix, smoothstep

Rgb = tuple[Column, Column, Column]

# Weights of luminance, and the centres of the eight hue bands.
LUMA = (0.2126, 0.7152, 0.0722)
BANDS = (0.0, 0.0833333333, 0.1666666667, 0.3333333333, 0.5, 0.6666666667, 0.75, 0.8333333333)


def luma(c: Rgb) -> Column:
    return c[0] * LUMA[0] + c[1] * LUMA[1] + c[2] * LUMA[2]


def each(c: Rgb, f) -> Rgb:
    return tuple(f(x) for x in c)


def encode(x: Column) -> Column:
    """Linear light to sRGB."""
    return F.when(x <= 0.0031308, x * 12.92).otherwise(1.055 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)


def linearize(x: Column) -> Column:
    """sRGB to linear light."""
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow(F.greatest((x + 0.055) / 1.055, F.lit(0.0)), F.lit(2.4)))


def exposure(c: Rgb, stops: float | Column) -> Rgb:
    return each(c, lambda x: encode(linearize(x) * F.pow(F.lit(2.0), F.lit(stops))))


def white_balance(c: Rgb, temperature: Column | float, tint: Column | float) -> Rgb:
    t, n = F.lit(temperature), F.lit(tint)
    return c[0] * (1 + t * 0.00008 + n * 0.00002), c[1] * (1 - F.abs(n) * 0.00003), c[2] * (1 - t * 0.00008 - n * 0.00002)


def tone_regions(c: Rgb, shadows: float, highlights: float, whites: float, blacks: float, contrast: float) -> Rgb:
    """Light moved in four ranges of luminance, then contrast about the middle."""
    y = luma(c)
    lift = smoothstep(0.7, 0.0, y) * shadows * 0.0015 + smoothstep(0.35, 1.0, y) * highlights * 0.0012 + smoothstep(0.72, 1.0, y) * whites * 0.0012 + smoothstep(0.25, 0.0, y) * blacks * 0.0012
    return each(c, lambda x: (x + lift - 0.5) * (1 + contrast * 0.0035) + 0.5)


def saturate(c: Rgb, saturation: float, vibrance: float) -> Rgb:
    """Saturation, then vibrance, which acts less on what is saturated already."""
    gray = luma(c)
    c = each(c, lambda x: mix(gray, x, max(0.0, 1 + saturation * 0.01)))
    spread = F.greatest(*c) - F.least(*c)
    scale = F.greatest(F.lit(0.0), 1 + vibrance * 0.01 * (1 - clamp(spread)))
    gray = luma(c)
    return each(c, lambda x: mix(gray, x, scale))


def to_hsl(c: Rgb) -> Rgb:
    """Hue, saturation and lightness from 0 to 1."""
    r, g, b = c
    high, low = F.greatest(*c), F.least(*c)
    d, light = high - low, (high + low) * 0.5
    gray = d <= 0.0001
    safe = F.when(gray, 1.0).otherwise(d)
    hue = F.when(high == r, F.pmod((g - b) / safe, F.lit(6.0))).when(high == g, (b - r) / safe + 2).otherwise((r - g) / safe + 4) / 6
    sat = d / F.when(gray, 1.0).otherwise(1 - F.abs(2 * light - 1))
    return F.when(gray, 0.0).otherwise(hue), F.when(gray, 0.0).otherwise(sat), light


def from_hsl(c: Rgb) -> Rgb:
    h, s, light = c
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q

    def channel(t: Column) -> Column:
        t = t - F.floor(t)
        return F.when(s <= 0.0001, light).when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)

    return channel(h + 1 / 3), channel(h), channel(h - 1 / 3)


def mixer(c: Rgb, bands: list[tuple[float, float, float]]) -> Rgb:
    """Hue, saturation and luminance shifts of eight hue bands, weighted by the distance on the hue circle."""
    def shifted(v: Column) -> Column:
        weights = F.array(*(smoothstep(0.18, 0.0, F.least(F.abs(v["h"] - m), 1 - F.abs(v["h"] - m))) for m in BANDS))
        sums = lambda w: [sum((F.element_at(w, i + 1) * b[k] * unit for i, b in enumerate(bands)), F.lit(0.0)) for k, unit in enumerate((1 / 360, 0.01, 0.005))]
        return let(weights, lambda w: (lambda t: F.struct((v["h"] + t[0]).alias("h"), clamp(v["s"] * (1 + t[1])).alias("s"), clamp(v["l"] + t[2]).alias("l")))(sums(w)))

    def back(v: Column) -> Column:
        return F.struct(*(x.alias(n) for x, n in zip(from_hsl((v["h"] - F.floor(v["h"]), v["s"], v["l"])), "rgb", strict=True)))

    hsl = F.struct(*(x.alias(n) for x, n in zip(to_hsl(each(c, clamp)), "hsl", strict=True)))
    out = let(let(hsl, shifted), back)
    return out["r"], out["g"], out["b"]


def vignette(c: Rgb, u: Column, v: Column, amount: float, midpoint: float = 50, feather: float = 50, roundness: float = 0, highlights: float = 0) -> Rgb:
    """Darker (or lighter) towards the edges, with highlights spared."""
    x, y = F.abs((u - 0.5) * 2), F.abs((v - 0.5) * 2)
    shape = mix(F.greatest(x, y), F.sqrt(x * x + y * y) * 0.70710678, roundness * 0.005 + 0.5)
    mid = 0.15 * (1 - midpoint * 0.01) + 0.8 * midpoint * 0.01
    soft = max(0.01, 0.03 * (1 - feather * 0.01) + 0.75 * feather * 0.01)
    mask = smoothstep(mid, mid + soft, shape) * (1 - smoothstep(0.45, 1.0, luma(c)) * highlights * 0.01)
    return each(c, lambda p: p * (1 - mask * max(0.0, -amount) * 0.008) + mask * max(0.0, amount) * 0.006)


def grain(c: Rgb, x: Column, y: Column, amount: float, size: float = 25, roughness: float = 50) -> Rgb:
    """Deterministic noise of two scales; its values are ours, only its statistics matter."""
    scale = 0.75 * (1 - size * 0.01) + 4.0 * size * 0.01
    gx, gy = x / scale, y / scale
    noise = lambda a, b: (lambda s: s - F.floor(s))(F.sin(a * 12.9898 + b * 78.233) * 43758.5453)
    n = mix(noise(gx, gy), noise(F.floor(gx * 0.5), F.floor(gy * 0.5)), roughness * 0.01)
    return each(c, lambda p: p + (n - 0.5) * amount * 0.004)


def overlay(c: Rgb, mask: Column, mode: str = "color") -> Rgb:
    """A mask shown over the picture: tinted, white, or as the mask itself."""
    if mode == "image":
        return each(c, lambda p: mix(p, mask, 0.82))
    tint = (1.0, 1.0, 1.0) if mode == "white" else (0.56, 0.72, 0.88)
    return tuple(mix(p, F.lit(t), mask * 0.42) for p, t in zip(c, tint, strict=True))


def framed(c: Rgb, original: Rgb, u: Column, v: Column, over_source: Column, show_original: Column) -> tuple[Column, ...]:
    """A finished pixel (r, g, b, alpha): transparent outside the picture where the crop is drawn over its source, the original if asked for, else clamped."""
    outside = over_source & ((u < 0) | (v < 0) | (u > 1) | (v > 1))
    shown = (F.when(outside, 0.0).when(show_original, o).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))) for p, o in zip(c, original, strict=True))
    return (*shown, F.when(outside, 0.0).otherwise(1.0))


def denoise_and_sharpen(c: Rgb, average: Rgb, noise: float, detail: float, contrast: float, color_noise: float, color_detail: float, color_smooth: float, sharpen: float, sharpen_detail: float, masking: float) -> Rgb:
    """Luminance and colour noise reduction against the neighbours' average, then unsharp masking with an edge mask."""
    blend = min(0.9, max(0.0, noise * 0.003 * (1.5 - detail * 0.01)))
    mean = luma(average)
    lift = (mean - luma(c)) * blend
    c = each(c, lambda x: x + lift)
    c = tuple(x + (x - a) * blend * contrast * 0.01 for x, a in zip(c, average, strict=True))
    tone = min(0.9, max(0.0, color_noise * 0.003 * (1.5 - color_detail * 0.01) * (0.5 + color_smooth * 0.01)))
    y = luma(c)
    c = tuple(y + mix(x - y, a - mean, tone) for x, a in zip(c, average, strict=True))
    far = F.sqrt(sum(((x - a) * (x - a) for x, a in zip(c, average, strict=True)), F.lit(0.0)))
    edge = mix(F.lit(1.0), smoothstep(masking * 0.0015, masking * 0.0015 + 0.04, far), masking * 0.01)
    return tuple(x + (x - a) * sharpen * 0.015 * (0.5 + sharpen_detail * 0.02) * edge for x, a in zip(c, average, strict=True))
