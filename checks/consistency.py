"""Keys that contradict themselves, in DuckDB: plain joins of cells under a key."""

from __future__ import annotations

from checks import views as V
from checks.views import text, with_

KEY = "policy_number"
SHARED = {c: [v for v in V.SESSION if c in V.COLUMNS[v]] for c in ("ncd", "product_type", "status")}
PLACES = "['" + "', '".join(V.SESSION) + "']"
CELLS = " UNION ALL ".join(
    f"SELECT {V.SESSION.index(v) + 1} AS place, {KEY} AS key, '{c}' AS col, {text(c)} AS value FROM {v} WHERE {KEY} IS NOT NULL"
    for c, views in SHARED.items() for v in views
)
MISMATCH = (
    f"SELECT '{KEY}' AS join_key, key, col AS \"column\", value, "
    f"array_to_string(list_transform(list_sort(list(DISTINCT place)), lambda p: {PLACES}[p]), ',') AS datasets, count(*) AS \"rows\" "
    "FROM cells WHERE (key, col) IN (SELECT x.key, x.col FROM cells x JOIN cells y "
    "ON x.key = y.key AND x.col = y.col AND x.place < y.place AND x.value IS DISTINCT FROM y.value) GROUP BY key, col, value"
)


def _agreement(ctes: dict[str, str]) -> dict[str, str]:
    """Adds, by pair of datasets, the cells that both hold and the mean similarity of their value sets."""
    pairs = [(a, b) for i, a in enumerate(V.SESSION) for b in V.SESSION[i + 1 :]]
    sets = "SELECT place, key, col, list(DISTINCT coalesce('=' || value, '-')) AS said FROM cells GROUP BY place, key, col"
    rated = " UNION ALL ".join(
        f"SELECT '{a}' AS dataset_a, '{b}' AS dataset_b, '{KEY}' AS join_key, count(*) AS cells, "
        "avg(len(list_intersect(x.said, y.said)) / len(list_distinct(list_concat(x.said, y.said)))) AS agreement "
        f"FROM sets x JOIN sets y ON x.key = y.key AND x.col = y.col WHERE x.place = {V.SESSION.index(a) + 1} AND y.place = {V.SESSION.index(b) + 1}"
        for a, b in pairs
    )
    return {**ctes, "cells": CELLS, "sets": sets, "agreement": rated}


def _duplicates(dataset: str, keys: list[str], columns: list[str], source: str) -> str:
    row = ", ".join(columns)
    return (
        f"SELECT '{dataset}' AS dataset, {', '.join(text(k) + ' AS ' + k for k in keys)}, count(*) AS \"rows\", count(DISTINCT row({row})) AS versions "
        f"FROM {source} WHERE {' AND '.join(k + ' IS NOT NULL' for k in keys)} GROUP BY {', '.join(keys)} HAVING count(*) > 1"
    )


def all_consistency(joined: dict[str, str], lineitem: list[str], most_agreement: float) -> dict[str, str]:
    views = {**V.view_ctes(*V.SESSION), "cells": CELLS}
    rated = _agreement(joined)
    return {
        "entity_mismatch": with_(views, MISMATCH),
        "mismatch_summary": with_(
            {**views, "found": MISMATCH},
            'SELECT join_key, "column", count(DISTINCT key) AS keys, CAST(count(*) AS BIGINT) AS "values" FROM found GROUP BY join_key, "column"',
        ),
        "exact_agreement": with_(
            rated, "SELECT dataset_a, dataset_b, join_key, cells, CAST(printf('%.4f', agreement) AS DOUBLE) AS agreement FROM agreement"
        ),
        "ghost_joins": with_(
            rated,
            "SELECT q.dataset_a, q.dataset_b, q.join_key, q.match_rate, CASE WHEN ghost THEN a.cells END AS cells, "
            "CASE WHEN ghost THEN CAST(printf('%.4f', agreement) AS DOUBLE) END AS agreement, ghost AS is_ghost FROM quality q "
            f"JOIN (SELECT *, coalesce(agreement <= {most_agreement}, false) AS low FROM agreement) a USING (dataset_a, dataset_b), "
            "LATERAL (SELECT low AND q.match_rate >= 0.5 AS ghost)",
        ),
        "duplicate_keys": with_(V.view_ctes("claims"), _duplicates("claims", [KEY], V.COLUMNS["claims"], "claims")),
        "duplicate_keys_entered": with_(
            V.view_ctes("policies", "policies_dup"), _duplicates("policies_dup", [KEY], V.COLUMNS["policies_dup"], "policies_dup")
        ),
        "duplicate_keys_pair": _duplicates("lineitem", ["l_partkey", "l_suppkey"], lineitem, "lineitem"),
    }
