"""Names, plans and comparison SQL of the library queries."""

from __future__ import annotations


def queries() -> dict:
    from silverframe.plans import change_plans, codec_plans, curation_plans, document_plans, image_plans, rule_plans, sidecar_plans, tile_plans  # noqa: F401

    return dict(image_plans.QUERIES)


def oracle_sql() -> dict[str, str]:
    from silverframe.plans import change_plans, codec_plans, curation_plans, document_plans, image_plans, rule_plans, sidecar_plans, tile_plans  # noqa: F401

    return dict(image_plans.ORACLE)
