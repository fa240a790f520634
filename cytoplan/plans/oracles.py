"""DuckDB SQL of the catalogue's queries. Edges come from the empty-circle rule, which needs no triangulation code."""

from __future__ import annotations

from .fixtures import EXPRESSION_SQL, LABELS_SQL, cells_sql, footprints_sql

_PARTS: dict[str, tuple[list[str], str]] = {
    "cells": ([], cells_sql()),
    "expression": (["cells"], EXPRESSION_SQL),
    "labels_a": (["cells"], LABELS_SQL[0]),
    "labels_b": (["cells"], LABELS_SQL[1]),
    "corners": (
        ["cells"],
        """SELECT a.sample_id, a.cell_id AS i, b.cell_id AS j, c.cell_id AS k, a.x_um AS ax, a.y_um AS ay, b.x_um AS bx, b.y_um AS by_, c.x_um AS cx, c.y_um AS cy,
  2 * (a.x_um * (b.y_um - c.y_um) + b.x_um * (c.y_um - a.y_um) + c.x_um * (a.y_um - b.y_um)) AS d
FROM cells a JOIN cells b ON a.sample_id = b.sample_id AND a.cell_id < b.cell_id JOIN cells c ON b.sample_id = c.sample_id AND b.cell_id < c.cell_id""",
    ),
    "circles": (
        ["corners"],
        """SELECT *, ((ax*ax+ay*ay)*(by_-cy)+(bx*bx+by_*by_)*(cy-ay)+(cx*cx+cy*cy)*(ay-by_))/d AS ux, ((ax*ax+ay*ay)*(cx-bx)+(bx*bx+by_*by_)*(ax-cx)+(cx*cx+cy*cy)*(bx-ax))/d AS uy FROM corners WHERE abs(d) > 1e-9""",
    ),
    "triangles": (
        ["circles", "cells"],
        """SELECT sample_id, i, j, k FROM circles t WHERE NOT EXISTS (SELECT 1 FROM cells p WHERE p.sample_id = t.sample_id AND p.cell_id NOT IN (i, j, k)
  AND (p.x_um-ux)*(p.x_um-ux)+(p.y_um-uy)*(p.y_um-uy) < (ax-ux)*(ax-ux)+(ay-uy)*(ay-uy) - 1e-9)""",
    ),
    "edges": (
        ["triangles", "cells"],
        """SELECT e.sample_id, e.src, e.dst, sqrt((p.x_um-q.x_um)*(p.x_um-q.x_um)+(p.y_um-q.y_um)*(p.y_um-q.y_um)) AS length
FROM (SELECT sample_id, i AS src, j AS dst FROM triangles UNION SELECT sample_id, j, k FROM triangles UNION SELECT sample_id, i, k FROM triangles) e
JOIN cells p ON p.sample_id = e.sample_id AND p.cell_id = e.src JOIN cells q ON q.sample_id = e.sample_id AND q.cell_id = e.dst""",
    ),
    "pruned": (["edges"], "SELECT * FROM edges WHERE length < 25"),
    "adj": (["pruned"], "SELECT sample_id, src AS a, dst AS b, length FROM pruned UNION ALL SELECT sample_id, dst, src, length FROM pruned"),
    "near": (["adj", "cells"], "SELECT sample_id, cell_id AS a, cell_id AS b FROM cells UNION SELECT sample_id, a, b FROM adj UNION SELECT x.sample_id, x.a, y.b FROM adj x JOIN adj y ON x.sample_id = y.sample_id AND x.b = y.a"),
    "three": (["near", "adj"], "SELECT sample_id, a, b FROM near UNION SELECT x.sample_id, x.a, y.b FROM near x JOIN adj y ON x.sample_id = y.sample_id AND x.b = y.a"),
    "ring": (
        ["near", "three", "adj"],
        """SELECT t.sample_id, t.a, t.b, CASE WHEN t.a = t.b THEN 0 WHEN e.a IS NOT NULL THEN 1 WHEN n.a IS NOT NULL THEN 2 ELSE 3 END AS hop
FROM three t LEFT JOIN (SELECT DISTINCT sample_id, a, b FROM adj) e ON e.sample_id = t.sample_id AND e.a = t.a AND e.b = t.b LEFT JOIN near n ON n.sample_id = t.sample_id AND n.a = t.a AND n.b = t.b""",
    ),
}
# flags: sample_id, cell_id, is_base, target_value. Each axis has its own.
FLAGS = {
    "celltype": (["cells"], "SELECT sample_id, cell_id, cell_type = 'tumor' AS is_base, CAST(cell_type = 'lymphocyte' AS INT)::DOUBLE AS target_value FROM cells"),
    "gene": (
        ["cells", "expression"],
        "SELECT c.sample_id, c.cell_id, coalesce(max(CASE WHEN gene = 'LIG' THEN value END) > 1, false) AS is_base, coalesce(avg(CASE WHEN gene IN ('REC', 'HLA-A') THEN value END), 0) AS target_value FROM cells c JOIN expression e ON e.sample_id = c.sample_id AND e.cell_id = c.cell_id GROUP BY 1, 2",
    ),
    "niche": (["cells", "labels_a", "labels_b"], "SELECT a.sample_id, a.cell_id, a.niche_id IN (0, 1) AS is_base, CAST(b.niche_id = 2 AS INT)::DOUBLE AS target_value FROM labels_a a JOIN labels_b b ON a.sample_id = b.sample_id AND a.cell_id = b.cell_id"),
}
_PARTS |= {
    "gate": (
        ["near", "flags"],
        "SELECT n.sample_id, n.a AS cell_id, count(*) AS n, CAST(sum(CAST(f.is_base AS INT)) AS BIGINT) AS n_base FROM near n JOIN flags f ON f.sample_id = n.sample_id AND f.cell_id = n.b GROUP BY 1, 2",
    ),
    "region": (["gate"], "SELECT *, n >= 8 AND n_base / n >= 0.5 AS is_region FROM gate"),
    "bordered": (
        ["region", "adj"],
        "SELECT r.*, r.is_region AND EXISTS (SELECT 1 FROM adj a JOIN region o ON o.sample_id = a.sample_id AND o.cell_id = a.b WHERE a.sample_id = r.sample_id AND a.a = r.cell_id AND NOT o.is_region) AS is_border FROM region r",
    ),
    "walk": (
        ["bordered", "adj"],
        "SELECT sample_id, cell_id, 0 AS depth FROM bordered WHERE is_border UNION SELECT w.sample_id, a.b, w.depth + 1 FROM walk w JOIN adj a ON a.sample_id = w.sample_id AND a.a = w.cell_id WHERE w.depth < 25",
    ),
    "layered": (
        ["walk", "bordered"],
        "SELECT b.sample_id, b.cell_id, b.is_region, b.is_border, h.hops, CASE WHEN b.is_region THEN -h.hops ELSE h.hops END AS layer FROM bordered b LEFT JOIN (SELECT sample_id, cell_id, min(depth) AS hops FROM walk GROUP BY 1, 2) h ON h.sample_id = b.sample_id AND h.cell_id = b.cell_id",
    ),
    "gap": (
        ["layered", "pruned"],
        "SELECT e.sample_id, least(x.layer, y.layer) AS layer, avg(e.length) AS gap FROM pruned e JOIN layered x ON x.sample_id = e.sample_id AND x.cell_id = e.src JOIN layered y ON y.sample_id = e.sample_id AND y.cell_id = e.dst WHERE abs(x.layer - y.layer) = 1 GROUP BY 1, 2",
    ),
    "counts": (
        ["layered", "flags"],
        "SELECT l.sample_id, l.layer, count(*) AS n, CAST(sum(CAST(f.is_base AS INT)) AS BIGINT) AS nb, CAST(sum(CAST(f.target_value > 0 AS INT)) AS BIGINT) AS nt, sum(f.target_value) AS t FROM layered l JOIN flags f ON f.sample_id = l.sample_id AND f.cell_id = l.cell_id WHERE l.layer IS NOT NULL GROUP BY 1, 2",
    ),
    "places": (
        ["gap", "counts"],
        """SELECT c.sample_id, c.layer, CASE WHEN c.layer = 0 THEN 0 WHEN c.layer > 0 THEN (SELECT sum(g.gap) FROM gap g WHERE g.sample_id = c.sample_id AND g.layer >= 0 AND g.layer < c.layer) ELSE (SELECT -sum(g.gap) FROM gap g WHERE g.sample_id = c.sample_id AND g.layer < 0 AND g.layer >= c.layer) END AS d,
  (SELECT count(*) FROM gap g WHERE g.sample_id = c.sample_id AND ((c.layer > 0 AND g.layer >= 0 AND g.layer < c.layer) OR (c.layer < 0 AND g.layer < 0 AND g.layer >= c.layer))) AS steps FROM counts c""",
    ),
    "curve": (
        ["places", "counts"],
        "SELECT c.sample_id, c.layer, round(nb / n, 6) AS base_type_prop, round(t / n, 6) AS target_type_prop, nb AS base_type_count, nt AS target_type_count, n AS all_type_count, round(d, 6) + 0.0 AS distance_um FROM counts c JOIN places p ON p.sample_id = c.sample_id AND p.layer = c.layer WHERE steps = abs(c.layer)",
    ),
    "spread": (
        ["region", "adj"],
        "SELECT sample_id, cell_id, cell_id AS root FROM region WHERE is_region UNION SELECT s.sample_id, a.b, s.root FROM spread s JOIN adj a ON a.sample_id = s.sample_id AND a.a = s.cell_id JOIN region r ON r.sample_id = a.sample_id AND r.cell_id = a.b AND r.is_region",
    ),
    "parts": (["spread"], "SELECT sample_id, cell_id, min(root) AS component FROM spread GROUP BY 1, 2"),
    "blobs": (
        ["parts", "cells"],
        "SELECT p.sample_id, component, row_number() OVER (PARTITION BY p.sample_id ORDER BY avg(y_um), avg(x_um), component) - 1 AS aggregate_id FROM parts p JOIN cells c ON c.sample_id = p.sample_id AND c.cell_id = p.cell_id GROUP BY 1, 2 HAVING count(*) >= 10",
    ),
    "members": (
        ["parts", "blobs", "cells"],
        "SELECT c.sample_id, c.cell_id, CAST(b.aggregate_id AS INT) AS aggregate_id FROM cells c LEFT JOIN parts p ON p.sample_id = c.sample_id AND p.cell_id = c.cell_id LEFT JOIN blobs b ON b.sample_id = p.sample_id AND b.component = p.component",
    ),
    "inside": (["members", "cells"], "SELECT m.sample_id, m.aggregate_id, c.cell_id, c.x_um AS x, c.y_um AS y FROM members m JOIN cells c ON c.sample_id = m.sample_id AND c.cell_id = m.cell_id WHERE m.aggregate_id IS NOT NULL"),
    # A side of the hull has no other member on its right, nor one on its line beyond its ends.
    "hull": (
        ["inside"],
        """SELECT p.sample_id, p.aggregate_id, sum(p.x * q.y - q.x * p.y) / 2 AS area FROM inside p JOIN inside q ON p.sample_id = q.sample_id AND p.aggregate_id = q.aggregate_id AND p.cell_id <> q.cell_id
WHERE NOT EXISTS (SELECT 1 FROM inside r WHERE r.sample_id = p.sample_id AND r.aggregate_id = p.aggregate_id AND (
  (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < -1e-9
  OR (abs((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) <= 1e-9 AND ((q.x - p.x) * (r.x - q.x) + (q.y - p.y) * (r.y - q.y) > 1e-9 OR (q.x - p.x) * (p.x - r.x) + (q.y - p.y) * (p.y - r.y) > 1e-9)))) GROUP BY 1, 2""",
    ),
    "pairs": ([], "SELECT * FROM (VALUES ('LIG', 'REC'), ('REC', 'HLA-A')) t(ligand, receptor)"),
}


def _gap2(px: str, py: str, s: str) -> str:
    """Squared distance of a point from segment ``s`` of columns x0, y0, x1, y1."""
    w, h = f"({s}.x1 - {s}.x0)", f"({s}.y1 - {s}.y0)"
    t = f"greatest(0, least(1, (({px} - {s}.x0) * {w} + ({py} - {s}.y0) * {h}) / ({w} * {w} + {h} * {h})))"
    return f"(pow({px} - {s}.x0 - {t} * {w}, 2) + pow({py} - {s}.y0 - {t} * {h}, 2))"


def _turn(s: str, px: str, py: str) -> str:
    return f"(({s}.x1 - {s}.x0) * ({py} - {s}.y0) - ({s}.y1 - {s}.y0) * ({px} - {s}.x0))"


def _shadow(s: str, pick: str) -> str:
    return f"CASE WHEN abs({s}.x1 - {s}.x0) >= abs({s}.y1 - {s}.y0) THEN {pick}({s}.x0, {s}.x1) ELSE {pick}({s}.y0, {s}.y1) END"


#: Sides of the footprints and their links, every side with every other.
_SIDES: dict[str, tuple[list[str], str]] = {
    **{f"foot_{name}": (["cells"], footprints_sql(name == "moved")) for name in ("still", "moved")},
    **{
        f"side_{name}": (
            [f"foot_{name}"],
            "SELECT sample_id, label, owner, s.* FROM (SELECT sample_id, label, owner, unnest([" + ", ".join(f"{{'x0': x{a}, 'y0': y{a}, 'x1': x{b}, 'y1': y{b}}}" for a, b in ("ab", "bc", "cd", "da")) + f"]) AS s FROM foot_{name})",
        )
        for name in ("still", "moved")
    },
    **{
        f"grid_{name}": (
            [f"side_{name}"],
            f"""SELECT sample_id, label, owner, least((u0, v0), (u1, v1))[1] * 0.25 AS x0, least((u0, v0), (u1, v1))[2] * 0.25 AS y0, greatest((u0, v0), (u1, v1))[1] * 0.25 AS x1, greatest((u0, v0), (u1, v1))[2] * 0.25 AS y1
FROM (SELECT *, round_even(x0 * 4, 0) AS u0, round_even(y0 * 4, 0) AS v0, round_even(x1 * 4, 0) AS u1, round_even(y1 * 4, 0) AS v1 FROM side_{name}) WHERE u0 <> u1 OR v0 <> v1""",
        )
        for name in ("still", "moved")
    },
    **{
        f"equal_{name}": (
            [f"grid_{name}"],
            f"SELECT DISTINCT p.sample_id, p.owner AS a, q.owner AS b, greatest(abs(p.x1 - p.x0), abs(p.y1 - p.y0)) AS len FROM grid_{name} p JOIN grid_{name} q ON p.sample_id = q.sample_id AND p.label = q.label AND p.x0 = q.x0 AND p.y0 = q.y0 AND p.x1 = q.x1 AND p.y1 = q.y1 AND p.owner < q.owner",
        )
        for name in ("still", "moved")
    },
    "once": (["grid_moved"], "SELECT sample_id, label, x0, y0, x1, y1, min(owner) AS owner FROM grid_moved GROUP BY ALL"),
    "beside": (
        ["once", "equal_moved"],
        f"""SELECT DISTINCT p.sample_id, p.owner AS a, q.owner AS b FROM once p JOIN once q ON p.sample_id = q.sample_id AND p.label = q.label AND p.owner < q.owner
WHERE least(p.x0, p.x1) <= greatest(q.x0, q.x1) AND least(q.x0, q.x1) <= greatest(p.x0, p.x1) AND least(p.y0, p.y1) <= greatest(q.y0, q.y1) AND least(q.y0, q.y1) <= greatest(p.y0, p.y1)
AND acos(least(1, abs((p.x1 - p.x0) * (q.x1 - q.x0) + (p.y1 - p.y0) * (q.y1 - q.y0)) / sqrt((pow(p.x1 - p.x0, 2) + pow(p.y1 - p.y0, 2)) * (pow(q.x1 - q.x0, 2) + pow(q.y1 - q.y0, 2))))) <= radians(3)
AND ((sign({_turn("p", "q.x0", "q.y0")}) * sign({_turn("p", "q.x1", "q.y1")}) < 0 AND sign({_turn("q", "p.x0", "p.y0")}) * sign({_turn("q", "p.x1", "p.y1")}) < 0)
  OR least({_gap2("p.x0", "p.y0", "q")}, {_gap2("p.x1", "p.y1", "q")}, {_gap2("q.x0", "q.y0", "p")}, {_gap2("q.x1", "q.y1", "p")}) <= 0.25)
AND least({_shadow("p", "greatest")}, {_shadow("q", "greatest")}) - greatest({_shadow("p", "least")}, {_shadow("q", "least")}) >= 1
UNION SELECT sample_id, a, b FROM equal_moved WHERE len >= 1""",
    ),
    "touch": (["beside", "equal_moved"], "SELECT sample_id, a, b FROM beside UNION SELECT sample_id, a, b FROM equal_moved"),
    "grown": (["foot_moved", "touch"], "SELECT sample_id, owner, owner AS root FROM foot_moved UNION SELECT g.sample_id, CASE WHEN t.a = g.owner THEN t.b ELSE t.a END, g.root FROM grown g JOIN touch t ON t.sample_id = g.sample_id AND g.owner IN (t.a, t.b)"),
    "joined": (["foot_still", "equal_still"], "SELECT sample_id, owner, owner AS root FROM foot_still UNION SELECT g.sample_id, CASE WHEN t.a = g.owner THEN t.b ELSE t.a END, g.root FROM joined g JOIN equal_still t ON t.sample_id = g.sample_id AND g.owner IN (t.a, t.b)"),
    "homes": (["joined"], "SELECT sample_id, owner, min(root) AS region FROM joined GROUP BY ALL"),
    "own_sides": (["side_still", "homes"], "SELECT s.*, region, least((x0, y0), (x1, y1)) AS p, greatest((x0, y0), (x1, y1)) AS q FROM side_still s JOIN homes h ON h.sample_id = s.sample_id AND h.owner = s.owner"),
    "lone": (["own_sides"], "SELECT sample_id, label, region, p, q, count(*) AS n FROM own_sides GROUP BY ALL"),
}


def _cci(kernel: str) -> dict[str, tuple[list[str], str]]:
    w = {"exponential": "exp(-length / 25.0)", "gaussian": "exp(-length * length / 1250.0)", "binary": "1.0"}[kernel]
    return {
        "w": (["adj"], f"SELECT sample_id, a, b, {w} AS w FROM adj"),
        "mass": (["w"], "SELECT sample_id, a AS cell_id, sum(w) AS m FROM w GROUP BY 1, 2"),
        "around": (["w", "expression"], "SELECT w.sample_id, w.a AS cell_id, e.gene, sum(w.w * e.value) AS s FROM w JOIN expression e ON e.sample_id = w.sample_id AND e.cell_id = w.b GROUP BY 1, 2, 3"),
        "scored": (
            ["cells", "pairs", "expression", "around", "mass"],
            """SELECT c.sample_id, c.cell_id, ligand, receptor, coalesce(l.value * ar.s / m.m, 0) AS out_mean, coalesce(l.value * ar.s, 0) AS out_sum, coalesce(r.value * al.s / m.m, 0) AS in_mean, coalesce(r.value * al.s, 0) AS in_sum
FROM cells c CROSS JOIN pairs LEFT JOIN expression l ON l.sample_id = c.sample_id AND l.cell_id = c.cell_id AND l.gene = ligand LEFT JOIN expression r ON r.sample_id = c.sample_id AND r.cell_id = c.cell_id AND r.gene = receptor
LEFT JOIN around al ON al.sample_id = c.sample_id AND al.cell_id = c.cell_id AND al.gene = ligand LEFT JOIN around ar ON ar.sample_id = c.sample_id AND ar.cell_id = c.cell_id AND ar.gene = receptor
LEFT JOIN mass m ON m.sample_id = c.sample_id AND m.cell_id = c.cell_id""",
        ),
    }


def build(select: str, needs: list[str], axis: str = "celltype", kernel: str = "exponential") -> str:
    """The statement with the parts that it needs, in order."""
    parts = {**_PARTS, **_SIDES, "flags": FLAGS[axis], **_cci(kernel)}
    done: list[str] = []

    def visit(name: str) -> None:
        if name not in done:
            for n in parts[name][0]:
                visit(n)
            done.append(name)

    for n in needs:
        visit(n)
    # Parts that are used twice are kept, not run again.
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('walk', 'spread', 'grown', 'joined') else 'MATERIALIZED '}({parts[n][1]})" for n in done) + "\n" + select


_SIX = lambda *names: ", ".join(f"round({n}, 6) AS {n}" for n in names)
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^0-9a-z_]+', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g')"
_TYPES = "(VALUES ('lymphocyte'), ('stroma'), ('tumor')) t(cell_type)"
_SOFT = "SELECT sample_id, cell_id, 'lymphocyte' AS cell_type, CAST(cell_id % 3 AS DOUBLE) / 4 AS p FROM cells UNION ALL SELECT sample_id, cell_id, 'stroma', 0.25 FROM cells UNION ALL SELECT sample_id, cell_id, 'tumor', CAST(3 - cell_id % 3 AS DOUBLE) / 4 FROM cells"


def _khop_features(probabilities: str) -> str:
    return build(
        f"""SELECT g.sample_id, g.cell_id, CAST(g.hop AS INT) AS hop, g.cell_type, round(CASE WHEN g.hop = 0 THEN coalesce(s, 0) / n WHEN n IS NULL THEN 1/3.0 ELSE (coalesce(s, 0) / n + 1/3.0) / 2 END, 6) AS value
FROM (SELECT sample_id, cell_id, hop, cell_type FROM cells0 CROSS JOIN (VALUES (0), (1), (2)) h(hop) CROSS JOIN {_TYPES}) g
LEFT JOIN (SELECT sample_id, a, hop, count(*) AS n FROM ring WHERE hop < 3 GROUP BY ALL) z ON z.sample_id = g.sample_id AND z.a = g.cell_id AND z.hop = g.hop
LEFT JOIN (SELECT r.sample_id, r.a, r.hop, p.cell_type, sum(p.p) AS s FROM ring r JOIN ({probabilities}) p ON p.sample_id = r.sample_id AND p.cell_id = r.b GROUP BY ALL) s ON s.sample_id = g.sample_id AND s.a = g.cell_id AND s.hop = g.hop AND s.cell_type = g.cell_type""".replace("cells0", "(SELECT sample_id, cell_id FROM cells)"),
        ["ring", "cells"],
    )


def oracle_sql() -> dict[str, str]:
    """Query name to SQL."""
    fills = "SELECT e.sample_id, CAST(e.layer AS INT) AS layer, base_type_prop, target_type_prop, base_type_count, target_type_count, all_type_count, distance_um FROM (SELECT sample_id, unnest(range(CAST(min(layer) AS BIGINT), CAST(max(layer) AS BIGINT) + 1)) AS layer FROM curve GROUP BY 1) e LEFT JOIN curve c ON c.sample_id = e.sample_id AND c.layer = e.layer"
    curve = "SELECT * REPLACE (CAST(layer AS INT) AS layer) FROM curve"
    scored = "SELECT sample_id, cell_id, ligand, receptor, " + _SIX("out_mean", "out_sum", "in_mean", "in_sum") + " FROM scored"
    shares = "SELECT niche_id, cell_type, sum(p) / count(DISTINCT (sample_id, cell_id)) AS share FROM (SELECT l.niche_id, l.sample_id, l.cell_id, t.cell_type, CAST(c.cell_type = t.cell_type AS INT) AS p FROM labels_a l JOIN cells c ON c.sample_id = l.sample_id AND c.cell_id = l.cell_id CROSS JOIN " + _TYPES + ") GROUP BY 1, 2"
    marks = "SELECT niche_id, gene, m AS mean_expr, log2((m + 1e-6) / (o + 1e-6)) AS log2_enrichment FROM (SELECT niche_id, gene, avg(value) AS m, sum(sum(value)) OVER (PARTITION BY gene) / sum(count(*)) OVER (PARTITION BY gene) AS o FROM labels_a l JOIN expression e ON e.sample_id = l.sample_id AND e.cell_id = l.cell_id GROUP BY 1, 2)"
    ab = "WITH x AS (SELECT a.niche_id AS i, b.niche_id AS j, count(*) AS n FROM labels_a a JOIN labels_b b ON a.sample_id = b.sample_id AND a.cell_id = b.cell_id GROUP BY 1, 2), p AS (SELECT i, j, n / sum(n) OVER () AS p FROM x), pa AS (SELECT i, sum(p) AS q FROM p GROUP BY 1), pb AS (SELECT j, sum(p) AS q FROM p GROUP BY 1) "
    return {
        "sanitize_labels": f"SELECT DISTINCT p_type AS raw, {_CLEAN.format('p_type')} AS label FROM part UNION SELECT DISTINCT o_orderpriority, {_CLEAN.format('o_orderpriority')} FROM orders",
        "gene_tags": "SELECT DISTINCT p_brand AS raw, upper(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) AS tag FROM part",
        "onehot_contract": build("SELECT sample_id, cell_id, x_um AS center_x_um, y_um AS center_y_um, " + ", ".join(f"CAST(cell_type = '{t}' AS INT)::DOUBLE AS prob_{t}" for t in ("lymphocyte", "stroma", "tumor")) + " FROM cells", ["cells"]),
        "hard_label": build("SELECT sample_id, cell_id, CASE WHEN pa >= pb AND pa >= pc THEN 'a' WHEN pb >= pc THEN 'b' ELSE 'c' END AS label FROM (SELECT sample_id, cell_id, cell_id % 3 AS pa, cell_id % 2 AS pb, (cell_id + 1) % 3 AS pc FROM cells)", ["cells"]),
        "normalised_probabilities": build("SELECT sample_id, cell_id, " + ", ".join(f"round({v} / (pa + pb + pc + 1e-8), 6) AS {v}" for v in ("pa", "pb", "pc")) + " FROM (SELECT sample_id, cell_id, CAST(cell_id % 3 AS DOUBLE) AS pa, CAST(cell_id % 2 AS DOUBLE) AS pb, CAST((cell_id + 1) % 3 AS DOUBLE) AS pc FROM cells)", ["cells"]),
        "type_counts": build("SELECT sample_id, cell_type, count(*) AS n_cells FROM cells GROUP BY 1, 2", ["cells"]),
        "verify_samples": build("SELECT sample_id, count(*) AS n_cells, count(DISTINCT cell_type) AS n_types, CAST(0 AS BIGINT) AS n_untyped, CAST(0 AS BIGINT) AS n_unplaced, true AS ok FROM cells GROUP BY 1", ["cells"]),
        "duplicate_ids": "SELECT CAST(c_nationkey AS BIGINT) AS sample_id, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
        "manifest_rows": "SELECT 'data/s' || n_nationkey || '.h5ad' AS path, CASE WHEN n_nationkey % 3 = 2 THEN 's' || n_nationkey ELSE n_name END AS sample_id FROM nation",
        "gene_panel_pairs": "SELECT * FROM (VALUES ('LIG', 'REC'), ('REC', 'HLA-A')) t(ligand, receptor)",
        "delaunay_edges": build("SELECT sample_id, src, dst, round(length, 6) AS length FROM edges", ["edges"]),
        "delaunay_triangles": build("SELECT sample_id, i AS a, j AS b, k AS c FROM triangles", ["triangles"]),
        "pruned_edges": build("SELECT sample_id, src, dst, round(length, 6) AS length FROM pruned", ["pruned"]),
        "adjacency": build("SELECT sample_id, a AS cell_id, count(*) AS n_neighbours, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS neighbours FROM adj GROUP BY 1, 2", ["adj"]),
        "khop_pairs": build("SELECT * FROM near", ["near"]),
        "exact_rings": build("SELECT sample_id, a, b, CAST(hop AS INT) AS hop FROM ring", ["ring"]),
        "region_gate": build("SELECT * FROM region", ["region"]),
        "border_cells": build("SELECT sample_id, cell_id, is_region, is_border FROM bordered", ["bordered"]),
        "hop_layers": build("SELECT sample_id, cell_id, is_region, CAST(hops AS INT) AS hops, CAST(layer AS INT) AS layer FROM layered", ["layered"]),
        "gap_lengths": build("SELECT sample_id, CAST(layer AS INT) AS layer, round(gap, 6) AS gap FROM gap", ["gap"]),
        "hplot_celltype": build(curve, ["curve"]),
        "hplot_gene": build(curve, ["curve"], "gene"),
        "hplot_niche": build(curve, ["curve"], "niche"),
        "hplot_aggregate": _axis_of(curve, "SELECT m.sample_id, m.cell_id, CAST(m.aggregate_id IS NOT NULL AS INT)::DOUBLE AS v FROM members m"),
        "hplot_cci": _axis_of(curve, "SELECT sample_id, cell_id, avg(out_mean) AS v FROM scored GROUP BY 1, 2"),
        "hplot_stream": build(curve, ["curve"]),
        "gapfill_summary": build(fills, ["curve"]),
        "layer_range": build("SELECT * REPLACE (CAST(layer AS INT) AS layer) FROM curve c WHERE layer BETWEEN -1 AND 2 AND (SELECT min(layer) <= -1 AND max(layer) >= 2 FROM curve d WHERE d.sample_id = c.sample_id)", ["curve"]),
        "summary_upsert": build("SELECT sample_id, CAST(layer AS INT) AS layer, CASE WHEN sample_id < 10 THEN 'new' ELSE 'old' END AS version FROM curve", ["curve"]),
        "enrichment_index": build("SELECT n.sample_id, n.a AS cell_id, round(sum(CAST(target_value > 0 AS INT)) * sum(CAST(target_value > 0 AS INT)) / (sum(CAST(target_value > 0 AS INT)) + sum(CAST(is_base AS INT)) + 1e-6), 6) AS enrichment FROM near n JOIN flags f ON f.sample_id = n.sample_id AND f.cell_id = n.b GROUP BY 1, 2", ["near", "flags"]),
        "components": build("SELECT sample_id, cell_id, component FROM parts", ["parts"]),
        "agg_membership": build("SELECT * FROM members", ["members"]),
        "agg_composition": build("SELECT g.sample_id, g.aggregate_id, g.cell_type, round(coalesce(k, 0) / n, 6) AS frac FROM (SELECT m.sample_id, m.aggregate_id, t.cell_type, count(DISTINCT m.cell_id) AS n FROM members m JOIN (SELECT DISTINCT sample_id, cell_type FROM cells) t ON t.sample_id = m.sample_id WHERE aggregate_id IS NOT NULL GROUP BY 1, 2, 3) g LEFT JOIN (SELECT m.sample_id, aggregate_id, cell_type, count(*) AS k FROM members m JOIN cells c ON c.sample_id = m.sample_id AND c.cell_id = m.cell_id WHERE aggregate_id IS NOT NULL GROUP BY 1, 2, 3) o ON o.sample_id = g.sample_id AND o.aggregate_id = g.aggregate_id AND o.cell_type = g.cell_type", ["members"]),
        "agg_super_nodes": build("SELECT m.sample_id, aggregate_id, count(*) AS n_cells, round(avg(x_um), 6) AS x_um, round(avg(y_um), 6) AS y_um FROM members m JOIN cells c ON c.sample_id = m.sample_id AND c.cell_id = m.cell_id WHERE aggregate_id IS NOT NULL GROUP BY 1, 2", ["members"]),
        "agg_features": build("SELECT i.sample_id, i.aggregate_id, count(*) AS n_cells, round_even(avg(x), 0) AS center_x_um, round_even(avg(y), 0) AS center_y_um, round(any_value(area), 6) AS area_um2 FROM inside i JOIN hull h ON h.sample_id = i.sample_id AND h.aggregate_id = i.aggregate_id GROUP BY 1, 2", ["inside", "hull"]),
        "quotient_edges": build("SELECT e.sample_id, least(x.niche_id, y.niche_id) AS lo, greatest(x.niche_id, y.niche_id) AS hi, count(*) AS n_edges FROM pruned e JOIN labels_a x ON x.sample_id = e.sample_id AND x.cell_id = e.src JOIN labels_a y ON y.sample_id = e.sample_id AND y.cell_id = e.dst WHERE x.niche_id <> y.niche_id GROUP BY 1, 2, 3", ["pruned", "labels_a"]),
        **{f"cci_{k}": build(scored, ["scored"], kernel=k) for k in ("exponential", "gaussian", "binary")},
        "cci_summary": build("SELECT sample_id, ligand, receptor, direction, aggregation, count(*) AS n_cells, round(avg(v), 6) AS mean, round(avg(CAST(v > 0 AS INT)), 6) AS frac_pos FROM (" + " UNION ALL ".join(f"SELECT sample_id, ligand, receptor, '{d}' AS direction, '{a}' AS aggregation, {d}_{a} AS v FROM scored" for d in ("out", "in") for a in ("mean", "sum")) + ") GROUP BY 1, 2, 3, 4, 5", ["scored"]),
        "khop_features_hard": _khop_features("SELECT sample_id, cell_id, cell_type, 1.0 AS p FROM cells"),
        "khop_features_soft": _khop_features(_SOFT),
        "khop_features_expr": build("SELECT c.sample_id, c.cell_id, CAST(h.hop AS INT) AS hop, g.gene, round(coalesce(v, 0), 6) AS value FROM cells c CROSS JOIN (VALUES (0), (1), (2)) h(hop) CROSS JOIN (VALUES ('LIG'), ('REC')) g(gene) LEFT JOIN (SELECT r.sample_id, r.a, r.hop, e.gene, avg(e.value) AS v FROM ring r JOIN expression e ON e.sample_id = r.sample_id AND e.cell_id = r.b GROUP BY ALL) s ON s.sample_id = c.sample_id AND s.a = c.cell_id AND s.hop = h.hop AND s.gene = g.gene", ["ring", "expression"]),
        "niche_sizes": build("SELECT niche_id, count(*) AS n_cells, round(count(*) / sum(count(*)) OVER (), 6) AS frac FROM labels_a GROUP BY 1", ["labels_a"]),
        "niche_composition": build(f"SELECT niche_id, cell_type, round(share, 6) AS share FROM ({shares})", ["labels_a"]),
        "niche_top_types": build(f"SELECT niche_id, CAST(rank AS INT) AS rank, cell_type, round(share, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY niche_id ORDER BY share DESC, cell_type) AS rank FROM ({shares})) WHERE rank <= 2", ["labels_a"]),
        "niche_markers": build(f"SELECT niche_id, CAST(row_number() OVER (PARTITION BY niche_id ORDER BY log2_enrichment DESC, gene) AS INT) AS rank, gene, round(mean_expr, 6) AS mean_expr, round(log2_enrichment, 6) AS log2_enrichment FROM ({marks})", ["labels_a", "expression"]),
        "niche_crosstab": build("SELECT a.niche_id AS niche_a, b.niche_id AS niche_b, count(*) AS n_cells FROM labels_a a JOIN labels_b b ON a.sample_id = b.sample_id AND a.cell_id = b.cell_id GROUP BY 1, 2", ["labels_a", "labels_b"]),
        "niche_nmi": build(f"SELECT * FROM ({ab} SELECT round((SELECT sum(p.p * ln(p.p / (pa.q * pb.q))) FROM p JOIN pa USING (i) JOIN pb USING (j)) / ((SELECT -sum(q * ln(q)) FROM pa) / 2 + (SELECT -sum(q * ln(q)) FROM pb) / 2), 6) AS nmi)", ["labels_a", "labels_b"]),
        "center_embeddings": "WITH l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id, CAST(i - 1 AS INT) AS pos, round(x - avg(x) OVER (PARTITION BY label, i) + avg(x) OVER (PARTITION BY i), 4) + 0.0 AS x FROM l",
        "knn_graph": "WITH d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) SELECT a, b, CAST(r AS INT) AS rank, round(d2, 6) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS r FROM d) WHERE r <= 15",
        "winner_setting": "SELECT CAST(p_size AS DOUBLE) AS resolution, n FROM (SELECT p_size, count(*) AS n, count(*) / sum(count(*)) OVER () AS f, avg(p_retailprice) AS s, max(p_retailprice) AS m FROM part GROUP BY 1) ORDER BY f >= 0.02 DESC, round(s, 6) DESC, m DESC, p_size LIMIT 1",
        "shared_sides": build("SELECT sample_id, a, b FROM equal_still", ["equal_still"]),
        "overlapping_sides": build("SELECT sample_id, a, b FROM beside", ["beside"]),
        "merged_regions": build("SELECT sample_id, owner, min(root) AS region FROM grown GROUP BY ALL", ["grown"]),
        # Holes of a connected region by Euler's formula.
        "region_outlines": build(
            """SELECT l.sample_id, l.label, l.region AS region_id, CAST(1 AS INT) AS n_shells, CAST(1 - v + e - f AS INT) AS n_holes, l.n_sides, round(area, 6) AS area, round(perimeter, 6) AS perimeter
FROM (SELECT sample_id, label, region, count(*) AS e, count(*) FILTER (n = 1) AS n_sides, sum(sqrt(pow(p[1] - q[1], 2) + pow(p[2] - q[2], 2))) FILTER (n = 1) AS perimeter FROM lone GROUP BY ALL) l
JOIN (SELECT sample_id, region, count(DISTINCT (x0, y0)) AS v, count(DISTINCT owner) AS f, sum(x0 * y1 - x1 * y0) / 2 AS area FROM own_sides GROUP BY ALL) o ON o.sample_id = l.sample_id AND o.region = l.region""",
            ["lone", "own_sides"],
        ),
        "stale_samples": build("SELECT DISTINCT sample_id FROM cells WHERE sample_id % 5 = 0", ["cells"]),
        "pending_samples": build("SELECT DISTINCT sample_id FROM cells WHERE sample_id % 2 = 1", ["cells"]),
    }


def _axis_of(select: str, values: str) -> str:
    """A curve whose target is a table made with the cell-type region first."""
    inner = build(values, ["members", "scored"])
    with_, _, rest = inner.partition("\nSELECT m.sample_id, m.cell_id, CAST(m.agg") if "CAST(m.agg" in values else inner.partition("\nSELECT sample_id, cell_id, avg(out_mean)")
    target = ("SELECT m.sample_id, m.cell_id, CAST(m.agg" if "CAST(m.agg" in values else "SELECT sample_id, cell_id, avg(out_mean)") + rest
    parts = {**_PARTS}
    order = ["counts", "places", "curve"]
    tail = [
        f"target AS MATERIALIZED ({target})",
        "flags2 AS MATERIALIZED (SELECT f.sample_id, f.cell_id, f.is_base, coalesce(t.v, 0) AS target_value FROM flags f LEFT JOIN target t ON t.sample_id = f.sample_id AND t.cell_id = f.cell_id)",
        f"bordered AS MATERIALIZED ({parts['bordered'][1]})",
        f"walk AS ({parts['walk'][1]})",
        f"layered AS MATERIALIZED ({parts['layered'][1]})",
        f"gap AS MATERIALIZED ({parts['gap'][1]})",
        *[f"{n} AS MATERIALIZED ({parts[n][1].replace('JOIN flags f', 'JOIN flags2 f')})" for n in order],
    ]
    return with_ + ",\n" + ",\n".join(tail) + "\n" + select
