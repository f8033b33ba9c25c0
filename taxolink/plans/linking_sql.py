"""DuckDB SQL of the queries in :mod:`taxolink.plans.linking`."""

from __future__ import annotations

from taxolink.plans import oracle as O
from taxolink.plans import standins as S

SQL: dict[str, str] = {}

# ---------------------------------------------------------------- text beam

_VECTORS = O.ORACLE["text_vectors"].rsplit("SELECT kind, id", 1)[0].strip()


def _level(prev: str, name: str, k: str) -> str:
    return f"""{name} AS (SELECT row_id, k0, k1, k2, class_idx, p FROM (
  SELECT b.row_id, b.k0, b.k1, b.k2, s.class_idx, s.p,
         row_number() OVER (PARTITION BY b.row_id, b.k0, b.k1, b.k2, b.class_idx ORDER BY s.p DESC, s.class_idx) AS rn
  FROM {prev} b JOIN tr e ON e.parent = b.class_idx JOIN sc s ON s.row_id = b.row_id AND s.class_idx = e.child) WHERE rn <= {k})"""


SQL["text_beam"] = _VECTORS + f""",
tv AS (SELECT kind, id, term_id, CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END AS weight FROM n),
dots AS (SELECT r.id AS row_id, c.id AS class_idx, sum(r.weight * c.weight) AS s
         FROM tv r JOIN tv c ON r.term_id = c.term_id AND r.kind = 'record' AND c.kind = 'class' GROUP BY ALL),
sc AS (SELECT d.doc_id AS row_id, b.item_id AS class_idx, coalesce(round(s, 9), 0.0) AS p
       FROM documents d CROSS JOIN benchmark b LEFT JOIN dots ON dots.row_id = d.doc_id AND dots.class_idx = b.item_id),
tr AS (SELECT item_id AS child, CASE WHEN item_id < {S.ITEM_ROOTS} THEN -1 ELSE (item_id - {S.ITEM_ROOTS}) // {S.ITEM_FANOUT} END AS parent
       FROM benchmark),
trip(k0, k1, k2) AS (VALUES {", ".join(map(str, S.BEAM_TRIPLES))}),
top AS (SELECT d.doc_id AS row_id, k0, k1, k2, -1 AS class_idx FROM documents d, trip),
{_level("top", "l0", "k0")},
{_level("l0", "l1", "k1")},
{",".join(_level(f"l{i}", f"l{i + 1}", "k2") for i in range(1, 8))}
SELECT DISTINCT row_id, CAST(k0 AS BIGINT) AS k0, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2, class_idx, round(p, 6) AS p
FROM ({" UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(9))})"""

# ---------------------------------------------------------------- trained head

_F, _H = 2 * S.EMBED_DIM, S.HEAD_HIDDEN


def _forward(name: str, x: str, t: int) -> str:
    """Hidden units and class-1 probability of the rows ``x (id, y, j, v)`` under weights ``t``."""
    return f"""{name}h AS MATERIALIZED (SELECT x.id, x.y, w.i, tanh(sum(x.v * w.v) + any_value(b.v)) AS h
  FROM {x} x JOIN w1_{t} w USING (j) JOIN b1_{t} b ON b.i = w.i GROUP BY x.id, x.y, w.i),
{name}p AS MATERIALIZED (SELECT id, y, 1.0 / (1.0 + exp(l0 - l1)) AS p FROM (
  SELECT h.id, h.y, sum(h.h * w.v) FILTER (w.c = 0) + (SELECT v FROM b2_{t} WHERE c = 0) AS l0,
         sum(h.h * w.v) FILTER (w.c = 1) + (SELECT v FROM b2_{t} WHERE c = 1) AS l1
  FROM {name}h h JOIN w2_{t} w USING (i) GROUP BY h.id, h.y))"""


def _step(t: int) -> str:
    rate = f"{S.HEAD_RATE} / (SELECT count(*) FROM s{t}p)"
    return f"""{_forward(f"s{t}", f"(SELECT * FROM xs WHERE step = {t % S.HEAD_STEPS})", t)},
s{t}z AS MATERIALIZED (SELECT h.id, h.i, (q.p - q.y) * u.v * (1 - h.h * h.h) AS dz FROM s{t}h h JOIN s{t}p q USING (id)
  JOIN (SELECT i, sum(CASE c WHEN 1 THEN v ELSE -v END) AS v FROM w2_{t} GROUP BY i) u USING (i)),
w1_{t + 1} AS MATERIALIZED (SELECT w.i, w.j, w.v - {rate} * g AS v FROM w1_{t} w JOIN (
  SELECT z.i, x.j, sum(z.dz * x.v) AS g FROM s{t}z z JOIN xs x USING (id) GROUP BY z.i, x.j) USING (i, j)),
b1_{t + 1} AS MATERIALIZED (SELECT b.i, b.v - {rate} * g AS v FROM b1_{t} b JOIN (SELECT i, sum(dz) AS g FROM s{t}z GROUP BY i) USING (i)),
w2_{t + 1} AS MATERIALIZED (SELECT w.c, w.i, w.v - {rate} * CASE w.c WHEN 1 THEN g ELSE -g END AS v FROM w2_{t} w JOIN (
  SELECT h.i, sum((q.p - q.y) * h.h) AS g FROM s{t}h h JOIN s{t}p q USING (id) GROUP BY h.i) USING (i)),
b2_{t + 1} AS MATERIALIZED (SELECT c, v - {rate} * CASE c WHEN 1 THEN g ELSE -g END AS v FROM b2_{t}, (SELECT sum(p - y) AS g FROM s{t}p))"""


_CE = "-ln(greatest(CASE WHEN y = 1 THEN p ELSE 1.0 - p END, 1e-12))"
_STEPS, _EPOCHS = S.HEAD_STEPS, range(S.HEAD_EPOCHS)

SQL["trained_head"] = "WITH " + O._EMB_LINKS + ", " + O.MASKS + f""",
lk AS (SELECT row_id * 2 + slot AS id, label AS y, feat, {O._u32("'step'", "row_id", "slot")} % {_STEPS} AS step,
              CASE WHEN rn <= ntr THEN 'train' WHEN rn <= ntr + nva THEN 'val' ELSE 'test' END AS part FROM ft JOIN md USING (row_id)),
xa AS MATERIALIZED (SELECT id, y, step, part, j, x * CASE WHEN j < {S.EMBED_DIM} THEN {S.HEAD_SCALE} ELSE {S.HEAD_SCALE ** 2} END AS v
  FROM (SELECT id, y, step, part, unnest(range({_F})) AS j, unnest(feat) AS x FROM lk)),
xs AS MATERIALIZED (SELECT * FROM xa WHERE part = 'train'),
w1_0 AS MATERIALIZED (SELECT i, j, 0.05 * sin(1 + {_F} * i + j) AS v FROM range({_H}) a(i), range({_F}) b(j)),
b1_0 AS MATERIALIZED (SELECT i, 0.0::DOUBLE AS v FROM range({_H}) a(i)),
w2_0 AS MATERIALIZED (SELECT c, i, 0.1 * sin(7 + {_H} * c + i) AS v FROM range(2) a(c), range({_H}) b(i)),
b2_0 AS MATERIALIZED (SELECT c, 0.0::DOUBLE AS v FROM range(2) a(c)),
{",".join(_step(t) for t in range(_STEPS * len(_EPOCHS)))},
{",".join(_forward(f"e{e}{part}", f"(SELECT * FROM xa WHERE part = '{part}')", _STEPS * (e + 1))
          for e in _EPOCHS for part in ("val", "test"))},
seen AS ({" UNION ALL ".join(f"SELECT {e} AS epoch, '{part}' AS part, y, p, CASE WHEN p > 1.0 - p THEN 1 ELSE 0 END AS pred FROM e{e}{part}p"
                             for e in _EPOCHS for part in ("val", "test"))}),
tl AS ({" UNION ALL ".join(f"SELECT {t // _STEPS} AS epoch, y, p FROM s{t}p" for t in range(_STEPS * len(_EPOCHS)))}),
vs AS (SELECT epoch, y, pred FROM seen WHERE part = 'val'),
ts AS (SELECT epoch, y, pred FROM seen WHERE part = 'test'),
vf AS {O._f1_sql('vs', 'y', 'pred', 'epoch')},
tf AS {O._f1_sql('ts', 'y', 'pred', 'epoch')},
vl AS (SELECT epoch, avg({_CE}) AS loss FROM seen WHERE part = 'val' GROUP BY epoch),
best AS (SELECT epoch FROM vl ORDER BY loss, epoch LIMIT 1),
sv AS (SELECT epoch, CASE WHEN f1 > coalesce(max(f1) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0)
              THEN 1.0 ELSE 0.0 END AS saved FROM vf)
SELECT CAST(epoch AS BIGINT) AS epoch, metric, round(value, 5) AS value FROM (
  SELECT epoch, 'train_loss' AS metric, avg({_CE}) AS value FROM tl GROUP BY epoch
  UNION ALL SELECT epoch, 'val_loss', loss FROM vl UNION ALL SELECT epoch, 'val_acc', f1 FROM vf UNION ALL SELECT epoch, 'saved', saved FROM sv
  UNION ALL SELECT epoch, 'test_loss', avg({_CE}) FROM seen JOIN best USING (epoch) WHERE part = 'test' GROUP BY epoch
  UNION ALL SELECT epoch, 'test_f1', f1 FROM tf JOIN best USING (epoch))"""

# ---------------------------------------------------------------- windows, epochs, member sets

SQL["window_match"] = """
WITH w AS (SELECT c_custkey AS window_id, c_custkey * 31 % 97 AS priority,
                  TIMESTAMP '1992-01-01' + to_days(CAST(c_custkey * 7 % 3650 AS INTEGER)) + to_hours(c_custkey % 24) AS lo,
                  1 + c_custkey * 13 % 400 AS days FROM customer),
hit AS (SELECT o_orderkey AS row_id, min({'p': priority, 'w': window_id}) AS best
        FROM orders JOIN w ON o_orderdate > lo AND o_orderdate < lo + to_days(CAST(days AS INTEGER)) GROUP BY o_orderkey)
SELECT o_orderkey AS row_id, best.w AS window_id FROM orders LEFT JOIN hit ON row_id = o_orderkey"""


def _permuted(rows: str, x: str) -> str:
    """Four Feistel turns of column ``x`` of ``rows (row_id, epoch, n, a, b, …)``."""
    out = f"(SELECT row_id, epoch, n, a, b, {x} // b AS l, {x} % b AS r FROM {rows})"
    for k in range(4):
        side, other, most = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        moved = f"({side} + {O._u32('epoch', str(k), other)}) % {most} AS {side}"
        out = f"(SELECT row_id, epoch, n, a, b, {moved if side == 'l' else 'l'}, {moved if side == 'r' else 'r'} FROM {out})"
    return f"SELECT row_id, epoch, n, a, b, l * b + r AS x FROM {out}"


SQL["epoch_batches"] = f"""
WITH RECURSIVE sz AS (SELECT n, a, (n + a - 1) // a AS b FROM (
  SELECT count(*) AS n, CAST(floor(sqrt(count(*) - 1)) AS BIGINT) + 1 AS a FROM orders)),
ix AS (SELECT o_orderkey AS row_id, epoch, n, a, b, row_number() OVER (PARTITION BY epoch ORDER BY o_orderkey) - 1 AS x
       FROM orders, range({S.HEAD_EPOCHS}) e(epoch), sz),
walk AS ({_permuted("ix", "x")}
  UNION ALL {_permuted("(SELECT * FROM walk WHERE x >= n)", "x")})
SELECT row_id, epoch, x AS position, x // {S.BATCH_SIZE} AS batch_id FROM walk WHERE x < n"""

SQL["class_overlap"] = O._with(O.CLS, O.CODES, O.LAB) + """,
sz AS (SELECT class_idx, count(*) AS n FROM lab GROUP BY class_idx),
bo AS (SELECT a.class_idx AS class_a, b.class_idx AS class_b, count(*) AS n_both
       FROM lab a JOIN lab b ON a.row_id = b.row_id AND a.class_idx < b.class_idx GROUP BY ALL)
SELECT CAST(class_a AS BIGINT) AS class_a, CAST(class_b AS BIGINT) AS class_b, x.n AS n_a, y.n AS n_b, n_both,
       x.n + y.n - n_both AS n_either, x.n - n_both AS n_only_a
FROM bo JOIN sz x ON x.class_idx = class_a JOIN sz y ON y.class_idx = class_b"""

# ---------------------------------------------------------------- hierarchy, staged files

SQL["path_ladder"] = """
WITH nd AS (SELECT DISTINCT p_size // 5 AS band, p_brand || ' ' || p_type AS kind FROM part),
ra AS (SELECT band, row_number() OVER (ORDER BY band) AS rung, count(*) AS k FROM nd GROUP BY band),
ty AS (SELECT kind, row_number() OVER (ORDER BY kind) AS place FROM (SELECT DISTINCT kind FROM nd)),
below AS (SELECT a.rung, coalesce(list_reduce(list(CAST(b.k AS HUGEINT)) FILTER (b.k IS NOT NULL), lambda x, y: x * y),
                                  CAST(1 AS HUGEINT)) AS n
          FROM ra a LEFT JOIN ra b ON b.rung < a.rung GROUP BY a.rung)
SELECT CAST(rung * 1000 + place AS BIGINT) AS node, CAST(rung - 1 AS BIGINT) AS depth, CAST(n AS VARCHAR) AS n_paths,
       CAST(floor(log2(CAST(n AS DOUBLE))) + 1 AS BIGINT) AS exponent
FROM nd JOIN ra USING (band) JOIN ty USING (kind) JOIN below USING (rung)"""

SQL["dag_ancestors"] = "WITH RECURSIVE " + O.DAG + """,
pe AS (SELECT DISTINCT child, parent FROM edges WHERE parent <> -1 AND child NOT IN (SELECT child FROM edges WHERE parent = -1)),
clo(node, ancestor) AS (SELECT child, parent FROM pe UNION SELECT clo.node, pe.parent FROM clo JOIN pe ON pe.child = clo.ancestor)
SELECT CAST(node AS BIGINT) AS node, CAST(ancestor AS BIGINT) AS ancestor FROM clo"""

SQL["feed_files"] = f"""
WITH y AS (SELECT year(o_orderdate) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) <> {S.LEFT_OUT_YEAR} GROUP BY 1),
e AS (SELECT year FROM (VALUES {", ".join(f"({y})" for y in S.EXPECTED_YEARS)}) v(year))
SELECT CAST(coalesce(y.year, e.year) AS BIGINT) AS year,
       CAST(CASE WHEN n IS NULL OR y.year = {S.CUT_YEAR} THEN 0 ELSE n END AS BIGINT) AS n_items,
       CAST(CASE WHEN y.year = {S.CUT_YEAR} THEN n ELSE 0 END AS BIGINT) AS n_broken,
       CASE WHEN n IS NULL THEN 'missing' WHEN y.year = {S.CUT_YEAR} THEN 'broken' WHEN e.year IS NULL THEN 'unexpected' ELSE 'ok' END AS status
FROM y FULL JOIN e ON y.year = e.year"""

# ---------------------------------------------------------------- dataset variant as one bundle

_MASK = "CASE WHEN is_train THEN 1 ELSE 0 END + CASE WHEN is_val THEN 2 ELSE 0 END + CASE WHEN is_test THEN 4 ELSE 0 END"
_PARTS = {
    "rows": (f"row_id, {_MASK}, CASE WHEN is_class THEN 1 ELSE 0 END, text",
             "(SELECT ac.*, is_train, is_val, is_test FROM ac LEFT JOIN rnd ON rnd.row_id = ac.row_id AND NOT is_class)"),
    "labels": ("row_id, class_idx, 0, kind",
               "(SELECT 'record' AS kind, row_id, class_idx FROM lab UNION ALL SELECT 'class', class_idx, class_idx FROM cls)"),
    "classes": ("class_idx, 0, 0, class_name", "cls"),
    "edges": ("child, parent, pos, ''", "edges"),
    "edges_indexed": ("src, dst, pos, form", "ei"),
    "depths": ("node, depth, count(*), ''", "rec GROUP BY node, depth"),
    "levels": ("DISTINCT node, depth, 0, ''", "rec"),
    "ancestors": ("node, ancestor, 0, ''", "clo")}


def _part(name: str) -> str:
    cols, table = _PARTS[name]
    distinct, cols = ("DISTINCT ", cols.removeprefix("DISTINCT ")) if cols.startswith("DISTINCT ") else ("", cols)
    return f"SELECT '{name}' AS part, a, b, c, text FROM (SELECT {distinct}{cols} FROM {table}) v(a, b, c, text)"


SQL["variant_bundle"] = O._RANDOM.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ac AS ({O.ORACLE["append_classes"]}),
{O.DAG},
{O.PATHS},
ei AS ({O.ORACLE["edges_indexed"]}),
clo(node, ancestor) AS (SELECT child, parent FROM pe UNION SELECT clo.node, pe.parent FROM clo JOIN pe ON pe.child = clo.ancestor)
SELECT part, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c, text FROM (
{" UNION ALL ".join(_part(p) for p in _PARTS)})"""
