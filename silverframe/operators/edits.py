"""Event-sourced edits: commands become patches of documents, with replay, undo, redo and persisted revisions.

A document's commands are folded in order with the state of one document in memory. Commands of all documents
stream through sorted partitions, so a document with many commands is never gathered.

A command is JSON: kind, and as its kind needs plugin, mask, component (ids), value, index, ids, asset, assets, new_mask. It yields patches
``{"at": [...path], "before": ..., "after": ...}``; none if it changes nothing. A command that can't be read, is
unknown, or would leave an invalid document is an error: it changes nothing, and the fold counts it.
"""

from __future__ import annotations

import copy
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HISTORY, MAX_MASKS, MAX_COMPONENTS, MAX_STROKES, MAX_POINTS = 100, 16, 64, 4096, 65536
PLUGINS = ("basic", "crop", "curve", "mixer", "effects")


class Invalid(ValueError):
    """A command or document that isn't allowed."""


def empty_document() -> dict:
    return {"global": {p: {} for p in PLUGINS}, "masks": [], "assets": {}}


def validate(doc: dict) -> None:
    """Ids of masks and components differ, components of kind ``ai`` have their asset, strokes and points keep to the limits."""
    parts = [c for m in doc["masks"] for c in m["components"]]
    ids = [m["id"] for m in doc["masks"]] + [c["id"] for c in parts]
    if len(ids) != len(set(ids)):
        raise Invalid("repeated id")
    if any(c.get("kind") == "ai" and c.get("asset") not in doc["assets"] for c in parts):
        raise Invalid("missing asset")
    strokes = [s for c in parts if c.get("kind") == "brush" for s in c.get("strokes", [])]
    if len(strokes) > MAX_STROKES or sum(len(s.get("points", [])) for s in strokes) > MAX_POINTS:
        raise Invalid("too many strokes or points")


def used_assets(masks: list[dict]) -> set:
    return {c["asset"] for m in masks for c in m["components"] if c.get("kind") == "ai"}


def replay(doc: dict, patches: list[dict], forward: bool = True) -> dict:
    """The document with patches applied in order, or taken back in reverse order."""
    out = dict(doc)
    for patch in patches if forward else reversed(patches):
        value = copy.deepcopy(patch["after" if forward else "before"])
        top, *key = patch["at"]
        if not key:
            out[top] = value
        elif value is None:
            out[top] = {k: v for k, v in out[top].items() if k != key[0]}
        else:
            out[top] = {**out[top], key[0]: value}
    return out


class Command:
    """One command against one document; ``patches`` are what it changes."""

    def __init__(self, doc: dict, command: dict):
        self.doc, self.c = doc, command
        self.masks: list[dict] = copy.deepcopy(doc["masks"])
        self.mask = next((m for m in self.masks if m["id"] == command.get("mask")), None)
        self.assets: dict = {}  # changed ones; None for those that go
        self.plugins: dict = {}
        kind = command.get("kind")
        run = getattr(self, "on_" + str(kind).replace("-", "_"), None)
        if run is None:
            raise Invalid(f"unknown command {kind}")
        run()

    def patches(self) -> list[dict]:
        changes = [(["assets", k], self.doc["assets"].get(k), v) for k, v in self.assets.items() if v is not None]
        changes += [(["global", p], self.doc["global"][p], v) for p, v in self.plugins.items()]
        changes.append((["masks"], self.doc["masks"], self.masks))
        changes += [(["assets", k], self.doc["assets"].get(k), None) for k, v in self.assets.items() if v is None]
        return [{"at": at, "before": before, "after": after} for at, before, after in changes if before != after]

    def drop_unused(self) -> None:
        used = used_assets(self.masks)
        self.assets |= {k: None for k in sorted({*self.doc["assets"], *self.assets}) if k not in used}

    def place(self, index, size: int) -> int:
        return max(0, min(size if index is None else int(index), size))

    def free_mask(self, mask_id) -> bool:
        return len(self.masks) < MAX_MASKS and all(m["id"] != mask_id for m in self.masks)

    def component(self, component_id) -> int:
        """Place of a component in the command's mask, -1 if there is none."""
        return next((i for i, c in enumerate(self.mask["components"] if self.mask else []) if c["id"] == component_id), -1)

    def plugin(self) -> str:
        if self.c.get("plugin") not in PLUGINS:
            raise Invalid(f"unknown plugin {self.c.get('plugin')}")
        return self.c["plugin"]

    def add_assets(self) -> None:
        self.assets |= {a["id"]: a for a in [*self.c.get("assets", []), *([self.c["asset"]] if "asset" in self.c else [])]}

    # settings of the whole image
    def on_replace_global(self):
        self.plugins[self.plugin()] = self.c["value"]

    def on_reset_plugin(self):
        self.plugins[self.plugin()] = {}

    def on_reset_all(self):
        self.plugins, self.masks = {p: {} for p in PLUGINS}, []
        self.drop_unused()

    # masks
    def on_insert_mask(self):
        if self.free_mask(self.c["value"]["id"]) and self.c["value"]["components"]:
            self.add_assets()
            self.masks.insert(self.place(self.c.get("index"), len(self.masks)), self.c["value"])

    def on_rename_mask(self):
        if self.mask:
            self.mask["name"] = self.c["value"].strip() or self.mask.get("name")

    def on_duplicate_mask(self):
        new, ids = self.c["value"], self.c.get("ids", [])
        if not self.mask or not self.free_mask(new) or len(ids) != len(self.mask["components"]) or len(set(ids)) < len(ids) or not all(ids):
            return
        twin = {**copy.deepcopy(self.mask), "id": new, "name": f"{self.mask.get('name', '')} copy"}
        for part, part_id in zip(twin["components"], ids, strict=True):
            part["id"] = part_id
        after = self.masks.index(self.mask) + 1
        self.masks.insert(self.place(self.c.get("index", after), len(self.masks)), twin)

    def on_move_mask(self):
        if self.mask:
            self.masks.remove(self.mask)
            self.masks.insert(self.place(self.c["value"], len(self.masks)), self.mask)

    def _set(self, name: str):
        if self.mask:
            self.mask[name] = self.c["value"]

    def on_set_mask_enabled(self):
        self._set("enabled")

    def on_set_mask_inverted(self):
        self._set("inverted")

    def on_set_mask_adjustments(self):
        self._set("adjustments")

    def on_replace_mask(self):
        new = self.c["value"]
        at = next((i for i, m in enumerate(self.masks) if m["id"] == new["id"]), -1)
        if at >= 0 and self.masks[at] != new:
            self.add_assets()
            self.masks[at] = new
            self.drop_unused()

    def on_remove_mask(self):
        if self.mask:
            self.masks.remove(self.mask)
            self.drop_unused()

    # components: the first one of a mask adds
    def on_insert_mask_component(self):
        new = self.c["value"]
        if not self.mask or self.component(new["id"]) >= 0 or len(self.mask["components"]) >= MAX_COMPONENTS:
            return
        at = self.place(self.c.get("index"), len(self.mask["components"]))
        if at > 0 or new["operation"] == "add":
            self.mask["components"].insert(at, new)

    def on_replace_mask_component(self):
        new = self.c["value"]
        at = self.component(new["id"])
        if at > 0 or at == 0 and new["operation"] == "add":
            self.mask["components"][at] = new

    def on_remove_mask_component(self):
        at = self.component(self.c.get("component"))
        if at < 0 or len(self.mask["components"]) == 1:
            return
        del self.mask["components"][at]
        if at == 0:
            self.mask["components"][0]["operation"] = "add"
        self.drop_unused()

    def on_set_mask_component_operation(self):
        at = self.component(self.c.get("component"))
        if at > 0 or at == 0 and self.c["value"] == "add":
            self.mask["components"][at]["operation"] = self.c["value"]

    # rasters
    def on_set_mask_assets(self):
        self.add_assets()

    def _ai(self) -> dict | None:
        """The command's component, if it is of kind ``ai`` and holds the command's asset."""
        new = self.c["value"]
        return new if new.get("kind") == "ai" and new.get("asset") == self.c["asset"]["id"] else None

    def on_complete_ai_mask(self):
        new = self._ai()
        if not new:
            return
        added = {**new, "operation": "add"}
        if self.c.get("mask") is not None:
            if not self.mask or len(self.mask["components"]) >= MAX_COMPONENTS or self.component(new["id"]) >= 0:
                return
            self.mask["components"].append(added)
        else:
            fresh = self.c.get("new_mask")
            if not fresh or not self.free_mask(fresh["id"]) or [(c["id"], c.get("kind")) for c in fresh["components"]] != [(new["id"], "ai")]:
                return
            self.masks.append({**fresh, "components": [added]})
        self.add_assets()

    def on_update_ai_mask(self):
        new, at = self._ai(), self.component(self.c.get("component"))
        if not new or at < 0 or self.mask["components"][at].get("kind") != "ai":
            return
        old = self.mask["components"][at]
        after = {**new, "id": old["id"], "operation": old["operation"]}
        if after != old:
            self.mask["components"][at] = after
            self.add_assets()
            self.drop_unused()


def command_patches(doc: dict, command: dict) -> list[dict]:
    """What a command changes; empty if nothing. Raises :class:`Invalid` if it isn't one or its result isn't valid."""
    try:
        patches = Command(doc, command).patches()
        if patches:
            validate(replay(doc, patches))
    except (KeyError, TypeError, AttributeError, ValueError) as e:
        raise e if isinstance(e, Invalid) else Invalid(f"malformed command: {type(e).__name__}") from e
    return patches


def apply_command(doc: dict, command: dict) -> dict:
    """The document after a command; the same object if nothing changes."""
    patches = command_patches(doc, command)
    return replay(doc, patches) if patches else doc


class Session:
    """One document with its history; document and metadata edits share the stacks."""

    def __init__(self):
        self.document, self.metadata = empty_document(), {"pick": "none", "rating": 0, "color_label": None}
        self.undo, self.redo, self.revision, self.persisted = [], [], 0, 0

    def step(self, command: dict) -> bool:
        """Apply a command, a history step, a hydration or a note of what is persisted; whether anything changed."""
        kind = command.get("kind") if isinstance(command, dict) else None
        if kind in ("undo", "redo"):
            source, sink = (self.undo, self.redo) if kind == "undo" else (self.redo, self.undo)
            if not source:
                return False
            entry = {**source.pop(), "group": None}
            sink.append(entry)
            del sink[:-HISTORY]
            self._take(entry, kind == "redo")
        elif kind == "edit-metadata":
            patches = [{"at": [k], "before": self.metadata.get(k), "after": v} for k, v in command["value"].items() if self.metadata.get(k) != v]
            if not patches:
                return False
            self._push("metadata", patches, None)
        elif kind == "hydrate":
            # a document from elsewhere is refused while edits are unsaved; history of metadata stays
            if self.revision != self.persisted:
                return False
            validate(command["value"])
            self.document = command["value"]
            self.undo, self.redo = ([x for x in stack if x["of"] == "metadata"] for stack in (self.undo, self.redo))
            return True
        elif kind == "mark-persisted":
            # compare and set: only a revision that exists and is later than the last
            if not self.persisted < command["value"] <= self.revision:
                return False
            self.persisted = command["value"]
            return True
        else:
            patches = command_patches(self.document, command)
            if not patches:
                return False
            self._push("document", patches, command.get("group"))
        self.revision += 1
        return True

    def _take(self, entry: dict, forward: bool) -> None:
        if entry["of"] == "document":
            self.document = replay(self.document, entry["patches"], forward)
        else:
            self.metadata = self.metadata | {p["at"][0]: p["after" if forward else "before"] for p in entry["patches"]}

    def _push(self, of: str, patches: list[dict], group) -> None:
        entry = {"of": of, "patches": patches, "group": group}
        self._take(entry, True)
        last = self.undo[-1] if self.undo else None
        if group is not None and last and last["of"] == of and last["group"] == group:
            last["patches"] = last["patches"] + patches
        else:
            self.undo.append(entry)
            del self.undo[:-HISTORY]
        self.redo.clear()


FOLDED = "entry long, revision long, persisted long, n_undo long, n_redo long, n_ignored long, n_errors long, last_error string, n_masks long, n_components long, document string, metadata string"


def fold_commands(log: DataFrame) -> DataFrame:
    """Final state of each entry of a log (entry, seq, command as JSON).

    Columns: entry, revision, persisted, n_undo, n_redo, n_ignored (commands without effect), n_errors and last_error, n_masks,
    n_components, document and metadata as JSON with sorted keys. A null command is an error.
    """
    schema = dict(part.split(" ") for part in FOLDED.split(", "))

    def run(batches):
        session, entry, ignored, errors, last = None, None, 0, 0, None

        def close():
            d = session.document
            values = [entry, session.revision, session.persisted, len(session.undo), len(session.redo), ignored, errors, last, len(d["masks"]), sum(len(m["components"]) for m in d["masks"]), json.dumps(d, sort_keys=True), json.dumps(session.metadata, sort_keys=True)]
            types = [pa.int64() if t == "long" else pa.string() for t in schema.values()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], list(schema))

        for batch in batches:
            for e, command in zip(batch.column("entry").to_pylist(), batch.column("command").to_pylist(), strict=True):
                if session is None or e != entry:
                    if session is not None:
                        yield close()
                    session, entry, ignored, errors, last = Session(), e, 0, 0, None
                try:
                    ignored += not session.step(json.loads(command) if command is not None else None)
                except (Invalid, KeyError, TypeError, AttributeError, ValueError) as e_:
                    errors, last = errors + 1, str(e_) if isinstance(e_, Invalid) else f"malformed command: {type(e_).__name__}"
        if session is not None:
            yield close()

    ordered = log.select(F.col("entry").cast("long"), "seq", "command").repartition("entry").sortWithinPartitions("entry", "seq")
    return ordered.select("entry", "command").mapInArrow(run, FOLDED)


def referenced_assets(documents: DataFrame) -> DataFrame:
    """Distinct assets that the masks of documents (id, masks: array of struct with components) refer to."""
    c = F.flatten(F.transform("masks", lambda m: F.transform(m["components"], lambda c: c["asset"])))
    return documents.select("id", F.explode(F.array_distinct(F.filter(c, lambda a: a.isNotNull()))).alias("asset_id"))
