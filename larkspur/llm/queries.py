"""The queries of this subpackage, each over its whole tables with production parameters."""

from __future__ import annotations

from ..plans.tables import table
from . import docpairs, handwritten, leakage, mixing, neighbours, syntax, webspam


def queries() -> dict:
    return {
        "p2_found": lambda s, d: syntax.found(table(s, d, "source_files")),
        "p2_rates": lambda s, d: syntax.rates(table(s, d, "source_files")),
        "p3_found": lambda s, d: handwritten.found(table(s, d, "source_files")),
        "p3_causes": lambda s, d: handwritten.causes(table(s, d, "source_files")),
        "p4_found": lambda s, d: docpairs.found(table(s, d, "outline_symbols")),
        "p4_pairs": lambda s, d: docpairs.documented(table(s, d, "outline_symbols")),
        "p5_found": lambda s, d: neighbours.found(table(s, d, "symbol_vectors")),
        "p5_exact": lambda s, d: neighbours.exact(table(s, d, "symbol_vectors")),
        "p5_recall": lambda s, d: neighbours.recall(table(s, d, "symbol_vectors")),
        "p6_found": lambda s, d: leakage.found(table(s, d, "documents"), table(s, d, "eval_items")),
        "p6_report": lambda s, d: leakage.report(table(s, d, "documents"), table(s, d, "eval_items")),
        "p7_mix": lambda s, d: mixing.mixed(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p7_shares": lambda s, d: mixing.shares(table(s, d, "documents"), table(s, d, "mix_targets")),
        "p8_found": lambda s, d: webspam.found(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the other operators are tested against brute force or fixtures."""
    return {
        "p5_exact": """
            WITH v AS (SELECT label, min(CAST(embedding AS DOUBLE[])) AS e FROM symbol_vectors
                WHERE label IS NOT NULL AND len(embedding) = 32
                  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 32
                  AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY label),
            d AS (SELECT a.label, b.label AS other, round(1 - list_cosine_similarity(a.e, b.e), 6) + 0.0 AS distance
                FROM v a JOIN v b ON a.label <> b.label WHERE a.label % 50 = 0)
            SELECT label, other, distance FROM d
            QUALIFY row_number() OVER (PARTITION BY label ORDER BY distance, other) <= 5""",
    }
