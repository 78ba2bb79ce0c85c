"""The queries of this subpackage and the same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import bestfit, centroids, exact, infilling, language, media, mixing, neardup, packing, personal, sharding, tokens, toxicity


def queries() -> dict:
    found = (
        tokens.op1_token_counts, media.op2_media_columns, neardup.op3_near_dedup, toxicity.op4_toxicity, language.op5_language_id, sharding.op6_sharding,
        personal.op7_personal_data, mixing.op8_mixing, packing.op9_packing, exact.op10_exact_dedup,
        bestfit.op11_best_fit_packing, centroids.op12_centroid_clustering, infilling.op13_fill_in_middle,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mixing": mixing.OP8_SQL, "op10_exact_dedup": exact.OP10_SQL, "op12_centroid_clustering": centroids.OP12_SQL, "op13_fill_in_middle": infilling.OP13_SQL}
