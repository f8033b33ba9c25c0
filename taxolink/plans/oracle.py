"""DuckDB SQL oracles for the driver queries (same names, same aliases, same types).

The SQL is written independently of the Spark plans: window functions and
joins straight over the pre-registered views. Parameters come from
:mod:`taxolink.plans.standins` so both sides use the same fixed values.
"""

from __future__ import annotations

from taxolink.plans import standins as S

SEED = S.SEED
_SENT = ", ".join(f"'{c}'" for c in S.SENTINEL_CODES)


def _md5(*exprs: str) -> str:
    parts = ", ".join(f"CAST({e} AS VARCHAR)" for e in exprs)
    return f"md5(concat_ws('#', '{SEED}', {parts}))"


def _u32(*exprs: str) -> str:
    return f"CAST(('0x' || substr({_md5(*exprs)}, 1, 8)) AS BIGINT)"


def _bound(year: int, plus_days: int = 0) -> str:
    b = f"timezone('UTC', timezone('{S.WINDOW_ZONE}', TIMESTAMP '{year}-01-01 00:00:00'))"
    return f"({b} + INTERVAL {plus_days} DAYS)" if plus_days else b


def _inside(ts: str, split: str) -> str:
    y0, y1 = S.TEMPORAL_WINDOWS[split]
    return f"({ts} > {_bound(y0)} AND {ts} < {_bound(y1, 365)})"


def _split_case(ts: str) -> str:
    return (f"CASE WHEN {_inside(ts, 'train')} THEN 'train' WHEN {_inside(ts, 'val')} THEN 'val' "
            f"WHEN {_inside(ts, 'test')} THEN 'test' ELSE 'none' END")


# Shared CTEs: catalogue A classes, raw codes and known labels of records.
CLS = f"""cls AS (
  SELECT p_brand AS class_name,
         row_number() OVER (ORDER BY min(TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER)), p_brand) - 1 AS class_idx
  FROM part WHERE p_brand NOT IN ({_SENT}) GROUP BY p_brand)"""
CODES = """codes AS (
  SELECT DISTINCT l.l_orderkey AS row_id, p.p_brand AS code
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""
LAB = """lab AS (
  SELECT DISTINCT c.row_id, k.class_idx FROM codes c JOIN cls k ON k.class_name = c.code)"""
SPLIT = f"""spl AS (
  SELECT o.o_orderkey AS row_id, {_split_case('o.o_orderdate')} AS split
  FROM orders o WHERE o.o_orderkey IN (SELECT row_id FROM lab))"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLE: dict[str, str] = {}

ORACLE["label_table"] = _with(CLS, CODES, LAB) + """
SELECT 'record' AS row_kind, row_id, CAST(count(*) AS BIGINT) AS n_labels,
       array_to_string(list_sort(list(class_idx)), ',') AS class_list
FROM lab GROUP BY row_id
UNION ALL
SELECT 'class' AS row_kind, CAST(class_idx AS BIGINT) AS row_id, CAST(1 AS BIGINT) AS n_labels,
       CAST(class_idx AS VARCHAR) AS class_list
FROM cls"""

ORACLE["labelled_only"] = _with(CLS, CODES, LAB) + """
SELECT o_orderkey AS row_id, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey IN (SELECT row_id FROM lab)"""

ORACLE["class_membership"] = _with(CLS, CODES, LAB) + """
SELECT CAST(class_idx AS BIGINT) AS class_idx, CAST(count(*) AS BIGINT) AS n_rows,
       min(row_id) AS min_row, max(row_id) AS max_row
FROM lab GROUP BY class_idx"""

ORACLE["temporal_split"] = _with(CLS, CODES, LAB, SPLIT) + """
SELECT s.split, CAST(l.class_idx AS BIGINT) AS class_idx, CAST(count(*) AS BIGINT) AS n_records
FROM spl s JOIN lab l USING (row_id) GROUP BY s.split, l.class_idx"""

ORACLE["class_cap"] = _with(CLS, CODES, LAB, SPLIT) + f"""
, tc AS (SELECT c.row_id, c.code FROM codes c JOIN spl s USING (row_id) WHERE s.split = 'train'),
rk AS (SELECT row_id, row_number() OVER (PARTITION BY code ORDER BY {_md5('code', 'row_id')}, row_id) AS rn FROM tc)
SELECT DISTINCT row_id FROM rk WHERE rn <= {S.CLASS_CAP}"""

ORACLE["stratified_split"] = _with(CLS, CODES, LAB, SPLIT) + f"""
, pool AS (SELECT l.row_id, l.class_idx FROM lab l JOIN spl s USING (row_id) WHERE s.split <> 'none'),
r AS (SELECT row_id, class_idx,
             row_number() OVER (PARTITION BY class_idx ORDER BY {_md5('class_idx', 'row_id')}, row_id) AS rn,
             count(*) OVER (PARTITION BY class_idx) AS cnt FROM pool),
d AS (SELECT row_id, rn, CAST(floor(cnt * {S.TRAIN_FRAC}::DOUBLE) AS BIGINT) AS ntr,
             CAST(floor(cnt * {S.VAL_FRAC}::DOUBLE) AS BIGINT) AS nva FROM r)
SELECT row_id, bool_or(rn <= ntr) AS is_train, bool_or(rn > ntr AND rn <= ntr + nva) AS is_val,
       bool_or(rn > ntr + nva) AS is_test
FROM d GROUP BY row_id"""

ORACLE["sample_n"] = _with(CLS, CODES, LAB) + f"""
SELECT row_id FROM (SELECT DISTINCT row_id FROM lab)
ORDER BY {_md5('row_id')}, row_id LIMIT {S.SAMPLE_N}"""


# ---------------------------------------------------------------- hierarchy

_REL_PARSE = """WITH r AS (
  SELECT p_partkey, p_brand, CASE WHEN p_size <= 5 THEN 'no relation' ELSE
    '::NATURE:ChildOf:CWE ID:' || CAST(p_size // 10 AS VARCHAR) || ':VIEW ID:1000::NATURE:ChildOf:CWE ID:' ||
    CAST(p_size // 3 AS VARCHAR) || ':VIEW ID:1003::NATURE:ChildOf:CWE ID:' || CAST(p_size // 10 AS VARCHAR) ||
    ':VIEW ID:1003::' END AS rel FROM part),
ids AS (SELECT p_partkey, p_brand,
          list_transform(regexp_extract_all(rel, 'ChildOf:CWE ID:(\\d+)', 1), lambda x: CAST(x AS BIGINT)) AS l FROM r),
dd AS (SELECT p_partkey, p_brand, list_filter(l, lambda x, i: list_position(l, x) = i) AS l FROM ids),
f AS (SELECT p_partkey, p_brand, CASE WHEN len(l) > 0 THEN l ELSE [CAST(-1 AS BIGINT)] END AS l FROM dd)
SELECT p_partkey, CAST(TRY_CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS BIGINT) AS brand_num,
       array_to_string(l, ',') AS parents, CAST(len(l) AS BIGINT) AS n_parents FROM f"""
ORACLE["parse_relations"] = _REL_PARSE

_SENT_IDS = ", ".join(str(i) for i in S.SENTINEL_NODE_IDS)
DAG = f"""b AS (
  SELECT p_partkey, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand, p_type,
         CAST({S.BAND_ID_BASE} + p_size // 10 AS BIGINT) AS band FROM part),
t AS (SELECT p_type, CAST({S.TYPE_ID_BASE} + dense_rank() OVER (ORDER BY p_type) - 1 AS BIGINT) AS tid
      FROM (SELECT DISTINCT p_type FROM part)),
tb AS (SELECT DISTINCT p_type, band FROM b),
edges AS (
  SELECT {S.PART_ID_BASE} + p_partkey AS child, 0 AS pos, brand AS parent FROM b WHERE brand NOT IN ({_SENT_IDS})
  UNION ALL
  SELECT {S.PART_ID_BASE} + b.p_partkey, CASE WHEN b.brand IN ({_SENT_IDS}) THEN 0 ELSE 1 END, t.tid
  FROM b JOIN t USING (p_type)
  UNION ALL
  SELECT t.tid, row_number() OVER (PARTITION BY t.tid ORDER BY tb.band) - 1, tb.band FROM tb JOIN t USING (p_type)
  UNION ALL
  SELECT DISTINCT brand, 0, -1 FROM b WHERE brand NOT IN ({_SENT_IDS})
  UNION ALL
  SELECT DISTINCT band, 0, -1 FROM b)"""
PATHS = """pe AS (SELECT DISTINCT child, parent FROM edges
       WHERE parent <> -1 AND child NOT IN (SELECT child FROM edges WHERE parent = -1)),
roots AS (SELECT DISTINCT child AS node FROM edges WHERE parent = -1),
rec(node, depth) AS (
  SELECT node, 0 FROM roots
  UNION ALL
  SELECT pe.child, rec.depth + 1 FROM rec JOIN pe ON pe.parent = rec.node)"""

ORACLE["edges_valid"] = _with(DAG) + """
SELECT CAST(child AS BIGINT) AS child, CAST(pos AS BIGINT) AS pos, CAST(parent AS BIGINT) AS parent FROM edges"""

ORACLE["edges_indexed"] = _with(DAG) + """
, ix AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS ix FROM (SELECT DISTINCT child AS node FROM edges)),
rt AS (SELECT DISTINCT child FROM edges WHERE parent = -1),
m AS (SELECT e.child, e.pos, e.parent, c.ix AS cix, CASE WHEN e.parent = -1 THEN -1 ELSE p.ix END AS pix,
             e.child IN (SELECT child FROM rt) AS is_root
      FROM edges e JOIN ix c ON c.node = e.child LEFT JOIN ix p ON p.node = e.parent)
SELECT 'child_parent' AS form, CAST(cix AS BIGINT) AS src, CAST(pos AS BIGINT) AS pos,
       CAST(CASE WHEN is_root THEN -1 ELSE pix END AS BIGINT) AS dst FROM m
UNION ALL
SELECT 'parent_child' AS form, CAST(pix AS BIGINT) AS src, CAST(pos AS BIGINT) AS pos, CAST(cix AS BIGINT) AS dst FROM m"""

ORACLE["depth_paths"] = "WITH RECURSIVE " + DAG + ",\n" + PATHS + """
SELECT CAST(node AS BIGINT) AS node, CAST(depth AS BIGINT) AS depth, CAST(count(*) AS BIGINT) AS n_paths
FROM rec GROUP BY node, depth"""

ORACLE["levels"] = "WITH RECURSIVE " + DAG + ",\n" + PATHS + """
SELECT DISTINCT CAST(depth AS BIGINT) AS depth, CAST(node AS BIGINT) AS node FROM rec"""

TREE = """te AS (
  SELECT CAST(1000 + s_suppkey AS BIGINT) AS child, CAST(100 + s_nationkey AS BIGINT) AS parent FROM supplier
  UNION ALL SELECT CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT) FROM nation),
clo(node, ancestor) AS (
  SELECT child, parent FROM te
  UNION
  SELECT clo.node, te.parent FROM clo JOIN te ON te.child = clo.ancestor)"""

ORACLE["ancestors"] = "WITH RECURSIVE " + TREE + """
SELECT node, ancestor FROM clo"""

ORACLE["expand_labels"] = "WITH RECURSIVE " + TREE + """,
lab AS (SELECT DISTINCT l_orderkey AS row_id, CAST(1000 + l_suppkey AS BIGINT) AS label FROM lineitem)
SELECT row_id, label FROM lab
UNION
SELECT lab.row_id, clo.ancestor FROM lab JOIN clo ON clo.node = lab.label"""

ORACLE["graph_listing"] = """
SELECT 'node' AS kind, CAST(100 + n_nationkey AS BIGINT) AS src, CAST(NULL AS BIGINT) AS dst,
       'CWE-ID ' || CAST(100 + n_nationkey AS VARCHAR) || ':' || n_name AS label FROM nation
UNION ALL SELECT 'node', 1000 + s_suppkey, NULL, 'CWE-ID ' || CAST(1000 + s_suppkey AS VARCHAR) || ':' || s_name FROM supplier
UNION ALL SELECT 'edge', 1000 + s_suppkey, CAST(100 + s_nationkey AS BIGINT), NULL FROM supplier
UNION ALL SELECT 'node', CAST(r_regionkey AS BIGINT), NULL, 'CWE-ID ' || CAST(r_regionkey AS VARCHAR) || ':' || r_name FROM region
UNION ALL SELECT 'node', 1003, NULL, 'CWE-ID 1003:Root Node'
UNION ALL SELECT 'edge', CAST(100 + n_nationkey AS BIGINT), CAST(n_regionkey AS BIGINT), NULL FROM nation
UNION ALL SELECT 'edge', CAST(r_regionkey AS BIGINT), 1003, NULL FROM region"""


# ---------------------------------------------------------------- link candidates

def _prime_of(c_expr: str) -> str:
    return (f"(SELECT min(n) FROM range({c_expr}, 2 * {c_expr} + 3) t(n) WHERE n >= 2 AND NOT EXISTS "
            f"(SELECT 1 FROM range(2, n) dv(q) WHERE n % q = 0 AND q * q <= n))")


def _link_ctes(lab: str, classes: str, k: int) -> str:
    """CTEs ``ll`` → ``fin(row_id, pos, neg)``: cyclic positives, and negatives drawn by a walk over the positions of the
    class table ``classes`` (its ``class_idx`` ascending)."""
    return f"""ids AS (SELECT list_sort(list(DISTINCT CAST(class_idx AS BIGINT))) AS cl FROM {classes}),
nc AS (SELECT len(cl) AS c FROM ids),
np AS (SELECT {_prime_of('(SELECT c FROM nc)')} AS p),
ll AS (SELECT row_id, list_sort(list(DISTINCT class_idx)) AS l FROM {lab} GROUP BY row_id),
par AS (SELECT row_id, l, (SELECT c FROM nc) AS c, (SELECT p FROM np) AS p,
               1 + {_u32("'a'", 'row_id')} % ((SELECT p FROM np) - 1) AS a,
               {_u32("'b'", 'row_id')} % (SELECT p FROM np) AS b FROM ll),
walk AS (SELECT row_id, l, list_filter(list_transform(
                  list_filter(list_transform(range(least({k} + p - c + len(l), p)), lambda j: (a * j + b) % p), lambda x: x < c),
                  lambda x: ids.cl[x + 1]), lambda y: NOT list_contains(l, y)) AS ok FROM par, ids),
lst AS (SELECT row_id, l, list_slice(ok, 1, {k}) AS ng FROM walk),
fin AS (SELECT row_id, list_transform(range({k}), lambda i: l[(i % len(l)) + 1]) AS pos,
               list_transform(range({k}), lambda i: ng[(i % len(ng)) + 1]) AS neg
        FROM lst WHERE len(l) > 0 AND len(ng) > 0)"""


_BRAND_LINKS = _with(CLS, CODES, LAB, _link_ctes("lab", "cls", S.K_LINKS))
ORACLE["pos_links"] = _BRAND_LINKS + "SELECT row_id, array_to_string(pos, ',') AS pos_links FROM fin"
ORACLE["neg_links"] = _BRAND_LINKS + "SELECT row_id, array_to_string(neg, ',') AS neg_links FROM fin"
ORACLE["links_flat"] = _BRAND_LINKS + f"""
, flat AS (SELECT row_id, i AS slot, pos[i + 1] AS class_idx, 1 AS label FROM fin, range({S.K_LINKS}) r(i)
           UNION ALL
           SELECT row_id, i + {S.K_LINKS}, neg[i + 1], 0 FROM fin, range({S.K_LINKS}) r(i)),
per AS (SELECT row_id, label, class_idx, count(*) AS n, min(slot) AS s0 FROM flat GROUP BY row_id, label, class_idx)
SELECT row_id, CAST(label AS BIGINT) AS label, CAST(sum(n) AS BIGINT) AS n_links, CAST(min(s0) AS BIGINT) AS first_slot,
       string_agg(CAST(class_idx AS VARCHAR) || ':' || CAST(n AS VARCHAR), ',' ORDER BY class_idx) AS class_counts
FROM per GROUP BY row_id, label"""

ORACLE["all_links"] = """
SELECT e.vec_id AS row_id, CAST(c.label AS BIGINT) AS class_idx
FROM embeddings e, (SELECT DISTINCT label FROM embeddings) c"""

# ---------------------------------------------------------------- scoring

_D = S.EMBED_DIM
EMB = f"""elab AS (SELECT vec_id AS row_id, CAST(label AS BIGINT) AS class_idx FROM embeddings),
emb AS (SELECT vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
cvp AS (SELECT label AS class_idx, i, avg(CAST(embedding[i + 1] AS DOUBLE)) AS m
        FROM embeddings, range({_D}) r(i) GROUP BY label, i),
cv AS (SELECT CAST(class_idx AS BIGINT) AS class_idx, list(m ORDER BY i) AS cvec FROM cvp GROUP BY class_idx)"""
_EMB_LINKS = EMB + ",\n" + _link_ctes("elab", "elab", 1) + """,
flat AS (SELECT row_id, 0 AS slot, pos[1] AS class_idx, 1 AS label FROM fin
         UNION ALL SELECT row_id, 1, neg[1], 0 FROM fin),
g AS (SELECT f.row_id, f.slot, f.class_idx, f.label, e.v, c.cvec
      FROM flat f JOIN emb e USING (row_id) JOIN cv c ON c.class_idx = f.class_idx),
ft AS (SELECT *, list_concat(list_transform(range(""" + str(_D) + """), lambda i: abs(v[i + 1] - cvec[i + 1])),
                             list_transform(range(""" + str(_D) + """), lambda i: v[i + 1] * cvec[i + 1])) AS feat FROM g)"""

ORACLE["pair_features"] = "WITH " + _EMB_LINKS + f"""
SELECT row_id, CAST(slot AS BIGINT) AS slot, CAST(class_idx AS BIGINT) AS class_idx, CAST(label AS BIGINT) AS label,
       CAST(len(feat) AS BIGINT) AS n_feat,
       round(list_sum(list_slice(feat, 1, {_D})), 4) + 0.0 AS f_abs,
       round(list_sum(list_slice(feat, {_D} + 1, {2 * _D})), 4) + 0.0 AS f_prod
FROM ft"""

_HEAD = f""",
hd AS (SELECT *, list_transform(range({_D}), lambda i: tanh(list_sum(list_transform(range({2 * _D}),
          lambda j: feat[j + 1] * (0.05 * sin(1 + {2 * _D} * i + j)))) + 0.01 * cos(i))) AS hid FROM ft),
lg AS (SELECT *, list_sum(list_transform(range({_D}), lambda i: hid[i + 1] * (0.1 * sin(7 + i)))) AS l0,
                 list_sum(list_transform(range({_D}), lambda i: hid[i + 1] * (0.1 * sin(7 + {_D} + i)))) AS l1 FROM hd),
sc AS (SELECT row_id, slot, class_idx, label, 1.0 / (1.0 + exp(l0 - l1)) AS p FROM lg)"""

ORACLE["link_scores"] = "WITH " + _EMB_LINKS + _HEAD + """
SELECT row_id, CAST(slot AS BIGINT) AS slot, CAST(class_idx AS BIGINT) AS class_idx, CAST(label AS BIGINT) AS label,
       round(p, 4) AS p FROM sc"""

ORACLE["link_loss"] = "WITH " + _EMB_LINKS + _HEAD + f""",
rb AS (SELECT row_id, (row_number() OVER (ORDER BY row_id) - 1) // {S.BATCH_SIZE} AS batch_id
       FROM (SELECT DISTINCT row_id FROM sc)),
ce AS (SELECT rb.batch_id, -ln(greatest(CASE WHEN label = 1 THEN p ELSE 1.0 - p END, 1e-12)) AS ce
       FROM sc JOIN rb USING (row_id)),
pb AS (SELECT batch_id, avg(ce) AS l, count(*) AS n FROM ce GROUP BY batch_id)
SELECT CAST(count(*) AS BIGINT) AS n_batches, CAST(sum(n) AS BIGINT) AS n_links, round(avg(l), 6) AS loss FROM pb"""

# ---------------------------------------------------------------- evaluation

DOCPRED = """dp AS (
  SELECT l.doc_id, l.quality, p1, 1.0 - p1 AS p0, CASE WHEN p1 > 1.0 - p1 THEN 1 ELSE 0 END AS pred
  FROM labels l JOIN (SELECT doc_id, 1.0 / (1.0 + exp(-(n_chars - 2000.0) / 500.0)) AS p1 FROM documents) d USING (doc_id))"""


def _f1_sql(src: str, truth: str, pred: str, group: str | None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""(SELECT {g}avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END) AS f1
  FROM (SELECT {g}c, count(*) FILTER (WHERE t AND hit) AS tp, count(*) FILTER (WHERE t AND NOT hit) AS fn,
               count(*) FILTER (WHERE NOT t AND NOT hit) AS fp
        FROM (SELECT {g}{truth} AS c, {truth} = {pred} AS hit, true AS t FROM {src}
              UNION ALL SELECT {g}{pred}, {truth} = {pred}, false FROM {src}) e
        GROUP BY {g}c) pc {gb})"""


ORACLE["macro_f1"] = _with(DOCPRED) + f"SELECT round(f1, 6) AS macro_f1 FROM {_f1_sql('dp', 'quality', 'pred', None)} x"

ORACLE["batch_f1"] = _with(DOCPRED) + f""", bd AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {S.BATCH_SIZE} AS batch_id FROM dp),
bf AS {_f1_sql('bd', 'quality', 'pred', 'batch_id')},
bn AS (SELECT batch_id, count(*) AS n FROM bd GROUP BY batch_id)
SELECT CAST(count(*) AS BIGINT) AS n_batches, round(sum(f1 * n) / sum(n), 6) AS epoch_f1 FROM bf JOIN bn USING (batch_id)"""

ORACLE["th_metrics"] = _with(DOCPRED) + f""", tp AS (SELECT *, CASE WHEN p1 >= {S.THRESHOLD} THEN 1 ELSE 0 END AS thp FROM dp)
SELECT 'th_acc' AS metric, round(avg(CASE WHEN thp = quality THEN 1.0 ELSE 0.0 END), 6) AS value FROM tp
UNION ALL
SELECT 'th_f1' AS metric, round(f1, 6) AS value FROM {_f1_sql('tp', 'quality', 'thp', None)} x"""

_TREE_VALUES = ", ".join(f"({c}, {p})" for c, p in S.CLASS_TREE)
_TRIPLES = ", ".join(f"({a}, {b}, {c})" for a, b, c in S.BEAM_TRIPLES)
BEAM = EMB + f""",
sc AS (SELECT e.row_id, c.class_idx,
              round(list_sum(list_transform(range({_D}), lambda i: e.v[i + 1] * c.cvec[i + 1])), 4) AS p
       FROM emb e, cv c),
tree(child, parent) AS (VALUES {_TREE_VALUES}),
trip(k0, k1, k2) AS (VALUES {_TRIPLES}),
l0 AS (SELECT row_id, k0, k1, k2, class_idx FROM (
         SELECT s.row_id, t.k0, t.k1, t.k2, s.class_idx,
                row_number() OVER (PARTITION BY s.row_id, t.k0, t.k1, t.k2 ORDER BY s.p DESC, s.class_idx) AS rn
         FROM sc s JOIN tree r ON r.child = s.class_idx AND r.parent = -1, trip t) WHERE rn <= k0),
"""


def _beam_level(prev: str, name: str, k: str) -> str:
    return f"""{name} AS (SELECT row_id, k0, k1, k2, class_idx FROM (
         SELECT b.row_id, b.k0, b.k1, b.k2, s.class_idx,
                row_number() OVER (PARTITION BY b.row_id, b.k0, b.k1, b.k2, b.class_idx ORDER BY s.p DESC, s.class_idx) AS rn
         FROM {prev} b JOIN tree e ON e.parent = b.class_idx JOIN sc s ON s.row_id = b.row_id AND s.class_idx = e.child)
       WHERE rn <= {k})"""


BEAM += ",\n".join([_beam_level("l0", "l1", "k1"), _beam_level("l1", "l2", "k2"), _beam_level("l2", "l3", "k2")]) + """,
vis AS (SELECT DISTINCT * FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3))
"""

ORACLE["beam_topk"] = "WITH " + BEAM + """
SELECT row_id, CAST(k0 AS BIGINT) AS k0, CAST(k1 AS BIGINT) AS k1, CAST(k2 AS BIGINT) AS k2,
       CAST(class_idx AS BIGINT) AS class_idx FROM vis"""

ORACLE["topk_accuracy"] = "WITH " + BEAM + """,
rec AS (SELECT elab.row_id, trip.k0, trip.k1, trip.k2 FROM elab, trip),
hit AS (SELECT DISTINCT v.row_id, v.k0, v.k1, v.k2 FROM vis v JOIN elab l ON l.row_id = v.row_id AND l.class_idx = v.class_idx)
SELECT CAST(r.k0 AS BIGINT) AS k0, CAST(r.k1 AS BIGINT) AS k1, CAST(r.k2 AS BIGINT) AS k2,
       round(avg(CASE WHEN h.row_id IS NULL THEN 0.0 ELSE 1.0 END), 6) AS accuracy
FROM rec r LEFT JOIN hit h ON h.row_id = r.row_id AND h.k0 = r.k0 AND h.k1 = r.k1 AND h.k2 = r.k2
GROUP BY r.k0, r.k1, r.k2"""

EPOCHS = """hs AS (SELECT event_type AS run_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch,
               sum(CAST(round(value * 100) AS BIGINT)) AS s, count(*) AS n
        FROM events GROUP BY 1, 2),
h AS (SELECT run_id, epoch, floor((200 * s + n) / (2.0 * n)) / 10000.0 AS val_acc,
             floor((200000000 * n + (100 * n + s)) / (2.0 * (100 * n + s))) / 1000000.0 AS loss FROM hs)"""

ORACLE["running_best"] = _with(EPOCHS) + """
SELECT run_id, epoch, val_acc,
       CAST(CASE WHEN val_acc > coalesce(max(val_acc) OVER (PARTITION BY run_id ORDER BY epoch
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0) THEN 1 ELSE 0 END AS BIGINT) AS saved
FROM h"""

ORACLE["history"] = _with(EPOCHS) + """
SELECT run_id, CAST(count(*) AS BIGINT) AS n_epochs,
       string_agg(CAST(CAST(round(val_acc * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY epoch) AS acc_hist
FROM h GROUP BY run_id"""

ORACLE["best_epoch"] = _with(EPOCHS) + """
SELECT run_id, epoch AS best_epoch, loss AS best_loss FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loss, epoch) AS rn FROM h) WHERE rn = 1"""

# ---------------------------------------------------------------- text

ORACLE["truncate_text"] = """
SELECT doc_id, substr(coalesce(text, 'nan'), 1, 512) AS text512,
       CAST(length(substr(coalesce(text, 'nan'), 1, 512)) AS BIGINT) AS n512 FROM documents"""


def all_oracles() -> dict[str, str]:
    from taxolink.plans.linking_sql import SQL
    return ORACLE | SQL


# ---------------------------------------------------------------- records, shape, sources

ORACLE["append_classes"] = _with(CLS, CODES) + r""", rc AS (SELECT row_id, list_sort(list(code)) AS l FROM codes GROUP BY row_id),
cat AS (SELECT TRY_CAST(regexp_extract(p_brand, '(\d+)', 1) AS INTEGER) AS id,
               arg_min(concat_ws(' ', coalesce(p_brand, 'nan'), coalesce(p_name, 'nan'), coalesce(p_type, 'nan'),
                                 coalesce(CAST(p_size AS VARCHAR), 'nan')), p_partkey) AS ctext
        FROM part GROUP BY 1)
SELECT 'record' AS row_kind, o.o_orderkey AS row_id, concat_ws(' ', o.o_orderpriority, o.o_orderstatus) AS text,
       array_to_string(coalesce(rc.l, ['NONE']), '|') AS labels, false AS is_class
FROM orders o LEFT JOIN rc ON rc.row_id = o.o_orderkey
UNION ALL
SELECT 'class', CAST(c.class_idx AS BIGINT), coalesce(cat.ctext, ''), c.class_name, true
FROM cls c LEFT JOIN cat ON cat.id = TRY_CAST(regexp_extract(c.class_name, '(\d+)', 1) AS INTEGER)"""

ORACLE["reject_filter"] = f"""
SELECT doc_id, CAST(length(split_part(text, chr(10), 1)) AS BIGINT) AS first_len FROM documents
WHERE text IS NOT NULL AND NOT contains(text, '{S.WITHDRAWN_MARKER}')"""

ORACLE["remap_unknown"] = _with(CODES) + f"""
, rc AS (SELECT o.o_orderkey AS row_id, coalesce(c.code, 'NONE') AS code
         FROM orders o LEFT JOIN codes c ON c.row_id = o.o_orderkey),
m AS (SELECT row_id, CASE WHEN code IN ({_SENT}) THEN 'UNKNOWN' ELSE code END AS code FROM rc)
SELECT row_id, code, CAST(CASE WHEN code IN ('UNKNOWN', 'NONE') THEN 0 ELSE 1 END AS BIGINT) AS kept FROM m"""

ORACLE["drop_sentinels"] = _with(CLS) + "SELECT class_name, CAST(class_idx AS BIGINT) AS class_idx FROM cls"

ORACLE["json_fields"] = """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d %H:%M') AS ts_minute,
       event_type FROM events"""

ORACLE["nested_feed"] = f"""
WITH f AS (SELECT conv_id, arg_min(text, turn) AS first_text,
                  array_to_string(list_sort(list_distinct(list(role))), '|') AS roles FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, CASE WHEN conv_id % 4 = 1 THEN '** {S.WITHDRAWN_MARKER} ** ' ELSE '' END || first_text AS text,
             CASE WHEN conv_id % 3 = 0 THEN 'NONE' ELSE roles END AS labels,
             strftime(TIMESTAMP '2001-03-04 05:06:00' + to_hours(conv_id) + to_minutes(conv_id % 60), '%Y-%m-%d %H:%M') AS published
      FROM f WHERE conv_id % 5 <> 0)
SELECT layout, 'CONV-' || CAST(conv_id AS VARCHAR) AS record_id, CAST(length(text) AS BIGINT) AS text_len, labels, published, feed_type
FROM r, (VALUES ('lines', ''), ('volumes', 'CVE')) v(layout, feed_type)
WHERE text IS NOT NULL AND NOT contains(text, '{S.WITHDRAWN_MARKER}')"""

_Q = "'"
ORACLE["parse_label_list"] = _with(CODES) + f""", rc AS (SELECT row_id, list_sort(list(code)) AS l FROM codes GROUP BY row_id),
t AS (SELECT row_id, CASE WHEN len(l) = 1 THEN l[1]
                          ELSE '[{_Q}{_Q}' || array_to_string(l, '{_Q}{_Q}, {_Q}{_Q}') || '{_Q}{_Q}]' END AS txt FROM rc),
p AS (SELECT row_id, txt, list_filter(string_split(trim(txt, '[]'), '{_Q}{_Q}'),
                                      lambda x: x NOT IN (',', ', ', '')) AS pl FROM t)
SELECT row_id, txt, CAST(len(pl) AS BIGINT) AS n, array_to_string(pl, '|') AS labels FROM p"""

ORACLE["html_first_list"] = r"""
WITH b AS (SELECT page_id, regexp_extract(html, '(?s)<ul[^>]*>(.*?)</ul>', 1) AS blk FROM pages),
r AS (SELECT page_id, regexp_extract_all(blk, '(?s)<li[^>]*>(.*?)</li>', 1) AS rws FROM b),
x AS (SELECT page_id, rws, unnest(range(len(rws))) AS i FROM r)
SELECT page_id, CAST(i AS BIGINT) AS pos,
       trim(replace(replace(replace(replace(replace(replace(regexp_replace(rws[i + 1], '<[^>]+>', '', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS item FROM x"""

ORACLE["batches"] = _with(CLS, CODES, LAB, SPLIT) + f"""
SELECT row_id, split,
       CAST((row_number() OVER (PARTITION BY split ORDER BY CASE WHEN split = 'train' THEN {_md5('row_id')} ELSE '' END,
                                row_id) - 1) // {S.BATCH_SIZE} AS BIGINT) AS batch_id
FROM spl WHERE split <> 'none'"""

_PROFILE_COLS = {
    "documents": (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "bigint")),
    "customer": (("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
                 ("c_mktsegment", "string")),
}
ORACLE["profile"] = "\nUNION ALL\n".join(
    f"SELECT '{t}' AS tbl, '{c}' AS col, '{ty}' AS type, CAST(count(*) AS BIGINT) AS n_rows, "
    f"CAST(count({c}) AS BIGINT) AS n_nonnull FROM {t}"
    for t, cols in _PROFILE_COLS.items() for c, ty in cols)

ORACLE["map_columns"] = """
SELECT c_custkey, upper(c_name) AS c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
       upper(c_mktsegment) AS c_mktsegment, upper(replace(c_name, '#', '|')) AS words,
       '{"k":"' || upper(c_mktsegment) || '"}' AS by_key FROM customer"""

_YEARS = ", ".join(f"({y})" for y in S.EXPECTED_YEARS)
ORACLE["feed_gaps"] = f"""
SELECT CAST(year AS BIGINT) AS year FROM (VALUES {_YEARS}) v(year)
WHERE year NOT IN (SELECT DISTINCT year(o_orderdate) FROM orders)"""

ORACLE["csv_roundtrip"] = """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment,
       CASE WHEN c_custkey % 7 <> 0 THEN c_name || ' "é, ü"' || chr(10) || c_mktsegment END AS c_note FROM customer"""

ORACLE["catalog_b"] = """
SELECT CAST(p_partkey AS BIGINT) AS node,
       p_name || ' ' || p_type || ', "é"' || chr(10) || p_brand || ' ' || CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'nan' END || ' ' ||
       CASE WHEN p_size % 3 <> 0 THEN '::SCOPE:' || p_size ELSE 'nan' END AS ctext,
       CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS VARCHAR) ELSE '-1' END AS parents FROM part"""

ORACLE["bundle_roundtrip"] = _with(CLS, CODES, LAB) + "SELECT row_id, CAST(class_idx AS BIGINT) AS class_idx FROM lab"

# ---------------------------------------------------------------- text

VOCAB = r"""w AS (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM documents),
wc AS (SELECT token, count(*) AS cnt FROM w GROUP BY token),
voc AS (SELECT token, CAST(row_number() OVER (ORDER BY cnt DESC, token) - 1 + 3 AS BIGINT) AS id,
               CAST(cnt AS BIGINT) AS cnt FROM wc)"""
ORACLE["vocab"] = _with(VOCAB) + """
SELECT token, id, cnt FROM voc
UNION ALL
SELECT token, CAST(id AS BIGINT), CAST(cnt AS BIGINT) FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<mask>', 2, 0)) v(token, id, cnt)"""

ENCODE = VOCAB + r""",
tw AS (SELECT doc_id, regexp_extract_all(coalesce(text, 'nan'), '[\p{L}\p{N}]+') AS tl FROM documents),
tk AS (SELECT doc_id, i, tl[i + 1] AS token FROM (SELECT doc_id, tl, unnest(range(len(tl))) AS i FROM tw)),
ti AS (SELECT tk.doc_id, tk.i, coalesce(v.id, 1) AS tid FROM tk LEFT JOIN voc v ON v.token = tk.token),
il AS (SELECT doc_id, list(tid ORDER BY i) AS ids FROM ti GROUP BY doc_id),
enc AS (SELECT d.doc_id, coalesce(il.ids, []) AS ids FROM documents d LEFT JOIN il USING (doc_id))"""

ORACLE["encode_pad"] = _with(ENCODE) + f""",
nb AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // {S.BATCH_SIZE} AS batch_id FROM enc),
mx AS (SELECT doc_id, ids, batch_id, max(len(ids)) OVER (PARTITION BY batch_id) AS L FROM nb)
SELECT doc_id, CAST(batch_id AS BIGINT) AS batch_id, CAST(len(ids) AS BIGINT) AS n_tokens, CAST(L AS BIGINT) AS padded_len,
       array_to_string(list_concat(ids, list_transform(range(L - len(ids)), lambda x: 0)), ',') AS ids,
       CAST(len(ids) AS BIGINT) AS mask_sum
FROM mx"""


def _unit_in_lambda(tag, pos: str) -> str:
    parts = ["'42'"] + ([f"'{tag}'"] if tag else []) + ["CAST(doc_id AS VARCHAR)", f"CAST({pos} AS VARCHAR)"]
    return f"CAST(('0x' || substr(md5(concat_ws('#', {', '.join(parts)})), 1, 8)) AS BIGINT)"


ORACLE["mask_tokens"] = _with(ENCODE) + f""", nv AS (SELECT count(*) AS nw FROM wc),
mk AS (SELECT doc_id, ids, nv.nw,
         list_transform(ids, lambda x, i: CASE WHEN {_unit_in_lambda(None, 'i - 1')} / 4294967296.0 < {S.MASK_RATE}
              THEN (CASE WHEN {_unit_in_lambda('r', 'i - 1')} / 4294967296.0 < 0.8 THEN 2
                         WHEN {_unit_in_lambda('r', 'i - 1')} / 4294967296.0 < 0.9 THEN 3 + {_unit_in_lambda('t', 'i - 1')} % nw
                         ELSE x END)
              ELSE x END) AS masked,
         len(list_filter(list_transform(ids, lambda x, i: {_unit_in_lambda(None, 'i - 1')} / 4294967296.0 < {S.MASK_RATE}),
                         lambda c: c)) AS n_chosen
       FROM enc, nv)
SELECT doc_id, CAST(n_chosen AS BIGINT) AS n_chosen, array_to_string(masked, ',') AS masked FROM mk"""

ORACLE["run_log"] = _with(EPOCHS) + """,
m AS (SELECT run_id, 'val_acc' AS key, epoch, val_acc AS value FROM h
      UNION ALL SELECT run_id, 'loss', epoch, loss FROM h)
SELECT run_id, key, key || ' :' || string_agg(CAST(value AS VARCHAR), ' ' ORDER BY epoch) AS line
FROM m GROUP BY run_id, key"""

# ---------------------------------------------------------------- links on expanded labels

ORACLE["neg_links_short"] = _with(CLS, CODES, LAB, _link_ctes("lab", "cls", S.K_SHORT)) + (
    "SELECT row_id, array_to_string(neg, ',') AS neg_links FROM fin")

NATIONS = """nod AS (
  SELECT CAST(100 + n_nationkey AS BIGINT) AS class_idx FROM nation UNION SELECT CAST(r_regionkey AS BIGINT) FROM region),
olab AS (SELECT DISTINCT l_orderkey AS row_id, CAST(100 + s_nationkey AS BIGINT) AS class_idx
         FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
wide AS (SELECT row_id, class_idx FROM olab
         UNION SELECT row_id, CAST(n_regionkey AS BIGINT) FROM olab JOIN nation ON class_idx = 100 + n_nationkey)"""

ORACLE["expanded_links"] = _with(NATIONS, _link_ctes("wide", "nod", S.K_SHORT)) + f"""
SELECT row_id, CAST(i AS BIGINT) AS slot, CAST(pos[i + 1] AS BIGINT) AS class_idx, CAST(1 AS BIGINT) AS label
FROM fin, range({S.K_SHORT}) r(i)
UNION ALL
SELECT row_id, CAST(i + {S.K_SHORT} AS BIGINT), CAST(neg[i + 1] AS BIGINT), CAST(0 AS BIGINT) FROM fin, range({S.K_SHORT}) r(i)"""

ORACLE["class_side"] = """
SELECT CAST(100 + n_nationkey AS BIGINT) AS row_id, CAST(100 + n_nationkey AS VARCHAR) AS o_labels,
       CAST(n_regionkey AS VARCHAR) || ',' || CAST(100 + n_nationkey AS VARCHAR) AS h_labels FROM nation
UNION ALL
SELECT CAST(r_regionkey AS BIGINT), CAST(r_regionkey AS VARCHAR), CAST(r_regionkey AS VARCHAR) FROM region
UNION ALL
SELECT 1000 + s_suppkey, CAST(1000 + s_suppkey AS VARCHAR),
       CAST(n_regionkey AS VARCHAR) || ',' || CAST(100 + n_nationkey AS VARCHAR) || ',' || CAST(1000 + s_suppkey AS VARCHAR)
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""

# ---------------------------------------------------------------- text vectors, fitted head, evaluation

ORACLE["text_vectors"] = r"""
WITH c AS (SELECT 'record' AS kind, doc_id AS id, text FROM documents
           UNION ALL SELECT 'class', item_id, text FROM benchmark),
w AS (SELECT kind, id, unnest(regexp_extract_all(text, '[\p{L}\p{N}]+')) AS token FROM c),
t AS (SELECT kind, id, token, count(*) AS tf FROM w GROUP BY ALL),
v AS (SELECT token, row_number() OVER (ORDER BY sum(tf) DESC, token) - 1 + 3 AS term_id,
             ln(((SELECT count(*) FROM c) + 1.0) / (count(*) + 1.0)) AS idf FROM t GROUP BY token),
x AS (SELECT kind, id, term_id, tf * idf AS w FROM t JOIN v USING (token)),
n AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY kind, id)) AS norm FROM x)
SELECT kind, id, CAST(term_id AS BIGINT) AS term_id, round(CASE WHEN norm > 0 THEN w / norm ELSE 0.0 END, 5) AS weight FROM n"""

MASKS = f"""mr AS (SELECT row_id, class_idx, row_number() OVER (PARTITION BY class_idx ORDER BY {_md5('class_idx', 'row_id')}, row_id) AS rn,
             count(*) OVER (PARTITION BY class_idx) AS cnt FROM elab),
md AS (SELECT row_id, rn, CAST(floor(cnt * {S.TRAIN_FRAC}::DOUBLE) AS BIGINT) AS ntr,
             CAST(floor(cnt * {S.VAL_FRAC}::DOUBLE) AS BIGINT) AS nva FROM mr)"""

ORACLE["pair_head_fit"] = "WITH " + _EMB_LINKS + ", " + MASKS + """
SELECT CAST(count(*) AS BIGINT) AS n_links, true AS better_than_none
FROM flat WHERE row_id IN (SELECT row_id FROM md WHERE rn <= ntr)"""

ORACLE["evaluate_split"] = "WITH " + _EMB_LINKS + _HEAD.replace("SELECT row_id, slot, class_idx, label, 1.0", f"SELECT row_id, slot, class_idx, label, list_sum(list_slice(feat, 1, {_D})) / {_D} AS tl, 1.0") + ", " + MASKS + f""",
sp AS (SELECT row_id, 'val' AS split FROM md WHERE rn > ntr AND rn <= ntr + nva
       UNION ALL SELECT row_id, 'test' FROM md WHERE rn > ntr + nva),
sb AS (SELECT row_id, split, (row_number() OVER (PARTITION BY split ORDER BY row_id) - 1) // {S.BATCH_SIZE} AS batch_id FROM sp),
j AS (SELECT sb.split, sb.batch_id, sb.split || '#' || sb.batch_id AS g, label, tl,
             -ln(greatest(CASE WHEN label = 1 THEN p ELSE 1.0 - p END, 1e-12)) AS ce,
             CASE WHEN p > 1.0 - p THEN 1 ELSE 0 END AS pred FROM sc JOIN sb USING (row_id)),
lb AS (SELECT split, batch_id, avg(ce) + {S.TEXT_LOSS_WEIGHT} * avg(tl) AS l FROM j GROUP BY split, batch_id),
fb AS {_f1_sql('j', 'label', 'pred', 'g')},
bn AS (SELECT split, g, count(*) AS n FROM j GROUP BY split, g)
SELECT split, 'loss' AS metric, round(avg(l), 5) AS value FROM lb GROUP BY split
UNION ALL
SELECT split, 'epoch_f1', round(sum(f1 * n) / sum(n), 5) FROM fb JOIN bn USING (g) GROUP BY split"""

# ---------------------------------------------------------------- dataset variants

_RANDOM = _with(CLS, CODES, LAB, SPLIT) + ", rnd AS (" + ORACLE["stratified_split"].split(SPLIT, 1)[1].strip().removeprefix(",").strip().replace(
    "pool AS", "WITH pool AS", 1) + ")"

ORACLE["split_sizes"] = _RANDOM + """
SELECT 'temporal' AS variant, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'val') AS n_val,
       count(*) FILTER (WHERE split = 'test') AS n_test FROM spl
UNION ALL
SELECT 'random', count(*) FILTER (WHERE is_train), count(*) FILTER (WHERE is_val), count(*) FILTER (WHERE is_test) FROM rnd"""

ORACLE["reset_masks"] = _RANDOM + """
SELECT o.o_orderkey AS row_id, coalesce(is_train, false) AS is_train, coalesce(is_val, false) AS is_val,
       coalesce(is_test, false) AS is_test FROM orders o LEFT JOIN rnd ON rnd.row_id = o.o_orderkey"""
