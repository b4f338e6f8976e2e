"""Queries on log sets, addresses and control flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.functions import vocabulary as V
from boardlens.operators import addresses as A
from boardlens.operators import cfg as C
from boardlens.operators import logset as S
from boardlens.operators import stores
from boardlens.sources import fixtures as X



def _sets(spark, sf_dir):
    lines = X.log_lines(spark, sf_dir)
    return S.parse_sets(lines.select(F.col("file").alias("set_id"), F.col("line_number").alias("n"), F.col("raw").alias("line")))


def logset_parse(spark, sf_dir):
    return _sets(spark, sf_dir).select("set_id", "error_count", "warning_count", "severity", "error_type", "device", "summary")


def logset_addresses(spark, sf_dir):
    return _sets(spark, sf_dir).select("set_id", F.size("crash_addresses").cast("long").alias("n"), F.array_join("crash_locations", ",").alias("locations"))


def logset_query(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return sets.select("set_id", S.retrieval_query(sets).alias("query"))


def chat_sets(spark, sf_dir):
    turns = X.table(spark, sf_dir, "conversations")
    lines = turns.select(F.col("conv_id").alias("set_id"), "turn", F.posexplode(T.lines(F.col("text"))).alias("at", "line"))
    sets = S.parse_sets(lines.select("set_id", F.struct("turn", "at").alias("n"), "line"))
    return sets.select("set_id", "n_lines", "error_count", "severity", "error_type")


def batch_counts(spark, sf_dir):
    sets = _sets(spark, sf_dir)
    return S.batch_counts(sets, F.col("severity") == "CRITICAL")


def _symbols(spark, sf_dir):
    return X.symbols(spark, sf_dir).withColumn("image", F.lit("image"))


def _code(spark, sf_dir):
    return X.instructions(spark, sf_dir)


def _crash(spark, sf_dir):
    return A.crash_addresses(X.log_lines(spark, sf_dir)).withColumn("image", F.lit("image"))


def crash_addresses(spark, sf_dir):
    return _crash(spark, sf_dir).select("file", F.col("address").cast("long").alias("address"), "line_number")


def resolve_function(spark, sf_dir):
    return A.resolve_functions(_crash(spark, sf_dir), _symbols(spark, sf_dir)).select("file", F.col("address").cast("long").alias("address"), "function", "offset")


def resolve_instruction(spark, sf_dir):
    code = _code(spark, sf_dir).withColumn("image", F.lit("image"))
    got = A.resolve_instructions(_crash(spark, sf_dir), code)
    return got.select("file", F.col("address").cast("long").alias("address"), "instruction", F.array_join(F.transform("nearby", lambda s: s["mnemonic"]), ",").alias("nearby"))


def anomalies(spark, sf_dir):
    code = _code(spark, sf_dir).withColumn("image", F.lit("image"))
    got = A.anomalies(X.log_lines(spark, sf_dir), _symbols(spark, sf_dir), code)
    return got.select("file", F.col("address").cast("long").alias("address"), "function", "severity", "description")


def symbols_page(spark, sf_dir):
    return stores.page(X.symbols(spark, sf_dir), ["seq"], 20, 100)


def symbol_search(spark, sf_dir):
    found = X.symbols(spark, sf_dir).where(F.lower("name").contains("_1"))
    return stores.page(found, ["seq"], 0, 50)


def instructions_page(spark, sf_dir):
    return stores.page(_code(spark, sf_dir), ["address"], 500, 5000)


def cfg_leaders(spark, sf_dir):
    return C.leaders(_code(spark, sf_dir), "arm")


def cfg_blocks(spark, sf_dir):
    return C.blocks(_code(spark, sf_dir))


def cfg_edges(spark, sf_dir):
    return C.edges(_code(spark, sf_dir)).select("fn", "from_block", "to_block", "edge_type", "comment")


def cfg_preds(spark, sf_dir):
    return C.predecessors(C.edges(_code(spark, sf_dir))).select("fn", "block", F.array_join(F.transform("preds", lambda p: p.cast("string")), ",").alias("preds"))


def cfg_stats(spark, sf_dir):
    s = C.statistics(_code(spark, sf_dir))
    return s.select("fn", "entry_block", "instructions", "blocks", "edges", F.coalesce(F.element_at("edge_types", "call"), F.lit(0)).alias("calls"))


def cfg_json(spark, sf_dir):
    return C.as_json(_code(spark, sf_dir))


def branch_targets(spark, sf_dir):
    own = C.classified(_code(spark, sf_dir), "arm")
    return own.where("target is not null").select("fn", F.col("target").alias("address")).join(own.select("fn", "address"), ["fn", "address"], "left_semi").distinct()


def unknown_calls(spark, sf_dir):
    """Direct calls whose target is no function's start."""
    own = C.classified(_code(spark, sf_dir), "arm")
    starts = own.groupBy("fn").agg(F.min("address").alias("target")).select("target")
    return own.where("kind = 'call' and target is not null").select("fn", "address", "target").join(starts, "target", "left_anti")


def call_closure(spark, sf_dir):
    """Functions reached from five entries of a program made from orders."""
    entries = spark.range(5).select((F.lit(X.BASE) + 4 * (F.col("id") * 100 + 1)).alias("address"))
    return C.call_closure(X.calls(spark, sf_dir), entries).select("address", F.col("depth").cast("long").alias("depth"), "has_code")


QUERIES = {f.__name__: f for f in (call_closure, logset_parse, logset_addresses, logset_query, chat_sets, batch_counts, crash_addresses, resolve_function, resolve_instruction, anomalies, symbols_page, symbol_search, instructions_page, cfg_leaders, cfg_blocks, cfg_edges, cfg_preds, cfg_stats, cfg_json, branch_targets, unknown_calls)}

_CRIT, _WARN = "|".join(V.CRITICAL_WORDS), "|".join(V.WARNING_WORDS)
_TYPE = rf"(?i)\b({'|'.join(V.ERROR_WORDS)})\b"


def _parse(source: str) -> str:
    return rf"""
l AS (SELECT * FROM (SELECT set_id, n, regexp_replace(line, '^\s+|\s+$', '', 'g') AS line FROM ({source})) WHERE line <> ''),
k AS (SELECT *, regexp_matches(lower(line), '{_CRIT}') AS critical, regexp_matches(lower(line), '{_WARN}') AS warning, lower(regexp_extract(line, '{_TYPE}', 1)) AS type, regexp_extract(line, '(PMON|pmon|STM32|NXP|Cortex|ARM|PowerPC)', 1) AS dev FROM l),
g AS (SELECT set_id, count(*) AS n_lines, count(*) FILTER (WHERE critical) AS critical, count(*) FILTER (WHERE warning) AS warning_count, coalesce(arg_min(type, n) FILTER (WHERE type <> ''), 'unknown') AS error_type,
coalesce(arg_min(dev, n) FILTER (WHERE dev <> ''), 'unknown') AS device, arg_min(line, n) FILTER (WHERE critical) AS first_critical, arg_min(line, n) FILTER (WHERE length(line) > 10) AS first_long FROM k GROUP BY set_id),
s AS (SELECT *, CASE WHEN critical > 0 THEN 'CRITICAL' WHEN warning_count > 0 THEN 'WARNING' ELSE 'INFO' END AS severity FROM g),
t AS (SELECT *, coalesce(first_critical, first_long, '[' || severity || '] ' || error_type || ' (' || CAST(n_lines AS VARCHAR) || ' lines)') AS line FROM s),
u AS (SELECT *, CASE WHEN length(line) > 120 THEN substr(line, 1, 120) || '...' ELSE line END AS summary FROM t)"""


_SET = "SELECT file AS set_id, line_number AS n, raw AS line FROM log_line"
_P = f"{X.LOG_LINES}, {_parse(_SET)}"
_FOUND = f"""{_P}, a AS (SELECT set_id, n, 0 AS p, unnest(regexp_extract_all(line, '(?:PC|pc).*?0x([0-9a-fA-F]{{8}})', 1)) AS h, 'PC=0x' AS lbl FROM l
UNION ALL SELECT set_id, n, 1, unnest(regexp_extract_all(line, '(?:LR|link).*?0x([0-9a-fA-F]{{8}})', 1)), 'LR=0x' FROM l
UNION ALL SELECT set_id, n, 2, unnest(regexp_extract_all(line, '(?i)RIP.*?(?:0x)?([0-9a-f]{{8}})', 1)), 'RIP=0x' FROM l),
b AS (SELECT set_id, list(lbl || upper(h) ORDER BY p, n) AS locs, list('0x' || upper(h) ORDER BY p, n) AS adr FROM a GROUP BY set_id)"""
_EACH = " UNION ALL ".join(f"SELECT file, line_number, raw, {k} AS p, generate_subscripts(h, 1) AS i, unnest(h) AS h FROM (SELECT file, line_number, raw, regexp_extract_all(raw, '{p}', 1) AS h FROM log_line)" for k, p in enumerate(V.CRASH_ADDRESSES))
_CRASH = f"{X.LOG_LINES}, ea AS ({_EACH}), ca AS (SELECT file, address, arg_min(line_number, (line_number, p, i)) AS line_number, arg_min(raw, (line_number, p, i)) AS raw FROM (SELECT *, CAST('0x' || h AS BIGINT) AS address FROM ea WHERE len(ltrim(h, '0')) <= 15) GROUP BY file, address)"
_FN = f"""{_CRASH}, {X.SYMBOLS}, rf AS (SELECT file, address, raw, CASE WHEN address < start + size THEN name ELSE '???' END AS function, CASE WHEN address < start + size THEN address - start ELSE 0 END AS "offset"
FROM ca ASOF LEFT JOIN (SELECT * FROM symbol WHERE size > 0) y ON ca.address >= y.start)"""
_INS = f"""{_FN}, {X.INSTRUCTIONS}, near AS (SELECT *, string_agg(mnemonic, ',') OVER (ORDER BY address ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS nearby FROM instruction),
ri AS (SELECT rf.file, rf.address, rf.function, rf."offset", rf.raw, CASE WHEN rf.address < i.address + i.byte_len THEN rtrim(i.mnemonic || ' ' || i.op_str) END AS instruction, CASE WHEN rf.address < i.address + i.byte_len THEN i.nearby END AS nearby
FROM rf ASOF LEFT JOIN near i ON rf.address >= i.address)"""
_CFG = f"""{X.INSTRUCTIONS},
k AS (SELECT *, CASE WHEN mnemonic = 'pop' AND op_str LIKE '%pc%' THEN 'return' WHEN mnemonic = 'bl' THEN 'call' WHEN mnemonic = 'beq' THEN 'conditional' WHEN mnemonic = 'b' THEN 'branch' ELSE 'plain' END AS kind,
CASE WHEN op_str LIKE '0x%' THEN CAST(op_str AS BIGINT) END AS target FROM instruction),
ld AS (SELECT fn, address FROM (SELECT fn, address, lag(kind) OVER (PARTITION BY fn ORDER BY address) AS before FROM k) WHERE before IS NULL OR before <> 'plain'
UNION SELECT k.fn, k.target FROM k JOIN k j ON j.fn = k.fn AND j.address = k.target WHERE k.kind <> 'plain'),
bk AS (SELECT k.*, sum(CASE WHEN ld.address IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY k.fn ORDER BY k.address ROWS UNBOUNDED PRECEDING) - 1 AS block FROM k LEFT JOIN ld USING (fn, address)),
la AS (SELECT *, lead(block) OVER (PARTITION BY fn ORDER BY block) AS next FROM (SELECT fn, block, arg_max(kind, address) AS kind, arg_max(target, address) FILTER (WHERE true) AS t0, max(address) AS la FROM bk GROUP BY fn, block)),
lb AS (SELECT la.fn, la.block, la.kind, la.next, bk.target, bk.mnemonic, bk.op_str, printf('0x%x', bk.target) AS adr FROM la JOIN bk ON bk.fn = la.fn AND bk.address = la.la),
lc AS (SELECT lb.*, bk.block AS dest FROM lb LEFT JOIN bk ON bk.fn = lb.fn AND bk.address = lb.target),
e AS (SELECT fn, block AS from_block, -1 AS to_block, 'return' AS edge_type, 'return via ' || mnemonic AS comment FROM lc WHERE kind = 'return'
UNION ALL SELECT fn, block, coalesce(dest, -1), 'call', CASE WHEN dest IS NULL THEN 'call via ' || mnemonic || ' (target unknown)' ELSE 'call to ' || adr END FROM lc WHERE kind = 'call'
UNION ALL SELECT fn, block, next, 'fallthrough', CASE kind WHEN 'call' THEN 'return from call (fall-through)' ELSE '' END FROM lc WHERE kind IN ('call', 'plain') AND next IS NOT NULL
UNION ALL SELECT fn, block, coalesce(dest, -1), CASE WHEN dest IS NULL THEN 'indirect_jump' ELSE 'jump' END, CASE WHEN dest IS NULL THEN 'jump target ' || adr || ' outside' ELSE 'jump to ' || adr END FROM lc WHERE kind = 'branch'
UNION ALL SELECT fn, block, next, 'conditional_false', 'branch not taken (fall-through)' FROM lc WHERE kind = 'conditional' AND next IS NOT NULL
UNION ALL SELECT fn, block, dest, 'conditional_true', 'branch taken to ' || adr FROM lc WHERE kind = 'conditional' AND dest IS NOT NULL)"""
_CALLS = f"""
c AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS p, {X.BASE} + 4 * o_orderkey AS address, CASE WHEN o_orderkey % 11 IN (3, 6) THEN {X.BASE} + 4 * ((o_orderkey * 37 + 11) % 600) END AS dest, o_orderkey % 11 = 9 AS stops FROM orders),
d AS (SELECT *, coalesce(sum(CAST(stops AS INTEGER)) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c),
g AS (SELECT DISTINCT a.address, b.dest FROM d a JOIN d b ON a.run = b.run AND b.p BETWEEN a.p AND a.p + 199 WHERE b.dest IS NOT NULL),
r AS (SELECT {X.BASE} + 4 * (100 * i + 1) AS address, 0 AS depth FROM range(5) t(i) UNION SELECT dest, depth + 1 FROM r JOIN g USING (address) WHERE depth < 200)"""
ORACLE = {
    "call_closure": f"WITH RECURSIVE {_CALLS} SELECT address, CAST(min(depth) AS BIGINT) AS depth, address IN (SELECT address FROM c) AS has_code FROM r GROUP BY address",
    "cfg_json": f"""WITH {_CFG}, b AS (SELECT fn, block, printf('0x%x', min(address)) AS a, printf('0x%x', max(address)) AS z FROM bk GROUP BY fn, block),
bb AS (SELECT fn, string_agg('{{"block":' || CAST(block AS VARCHAR) || ',"start":"' || a || '","end":"' || z || '"}}', ',' ORDER BY block) AS t FROM b GROUP BY fn),
ee AS (SELECT fn, string_agg('{{"from_block":' || CAST(from_block AS VARCHAR) || ',"to_block":' || CAST(to_block AS VARCHAR) || ',"edge_type":"' || edge_type || '","comment":"' || comment || '"}}', ',' ORDER BY from_block, to_block, edge_type) AS t FROM e GROUP BY fn)
SELECT fn, '{{"blocks":[' || bb.t || '],"edges":[' || coalesce(ee.t, '') || ']}}' AS json FROM bb LEFT JOIN ee USING (fn)""",
    "logset_parse": f"WITH {_P} SELECT set_id, critical + warning_count AS error_count, warning_count, severity, error_type, device, summary FROM u",
    "logset_addresses": f"WITH {_FOUND} SELECT u.set_id, CAST(coalesce(len(locs), 0) AS BIGINT) AS n, coalesce(array_to_string(locs, ','), '') AS locations FROM u LEFT JOIN b USING (set_id)",
    "logset_query": f"WITH {_FOUND} SELECT u.set_id, array_to_string([error_type, device] || coalesce(adr[1:3], []) || coalesce(locs[1:5], []) || [substr(summary, 1, 200)], ' ') AS query FROM u LEFT JOIN b USING (set_id)",
    "chat_sets": f"WITH {_parse('SELECT conv_id AS set_id, turn * 100000 + i AS n, ls[i] AS line FROM (SELECT conv_id, turn, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))')} SELECT set_id, n_lines, critical + warning_count AS error_count, severity, error_type FROM u",
    "batch_counts": f"WITH {_P} SELECT count(*) FILTER (WHERE severity = 'CRITICAL') AS succeeded, count(*) FILTER (WHERE severity <> 'CRITICAL') AS failed, count(*) AS total FROM u",
    "crash_addresses": f"WITH {_CRASH} SELECT file, address, line_number FROM ca",
    "resolve_function": f'WITH {_FN} SELECT file, address, function, "offset" FROM rf',
    "resolve_instruction": f"WITH {_INS} SELECT file, address, instruction, nearby FROM ri",
    "anomalies": f"""WITH {_INS} SELECT file, address, function, CASE WHEN lower(raw) LIKE '%fault%' THEN 'CRITICAL' ELSE 'WARNING' END AS severity, 'Crash at ' || CASE function WHEN '???' THEN printf('0x%x', address) ELSE function END || '+' || printf('0x%x', "offset") AS description FROM ri WHERE function <> '???' OR nearby IS NOT NULL""",
    "symbols_page": f"WITH {X.SYMBOLS} SELECT *, (SELECT count(*) FROM symbol) AS total FROM symbol ORDER BY seq LIMIT 100 OFFSET 20",
    "symbol_search": f"WITH {X.SYMBOLS} SELECT *, (SELECT count(*) FROM symbol WHERE lower(name) LIKE '%\\_1%' ESCAPE '\\') AS total FROM symbol WHERE lower(name) LIKE '%\\_1%' ESCAPE '\\' ORDER BY seq LIMIT 50",
    "instructions_page": f"WITH {X.INSTRUCTIONS} SELECT *, (SELECT count(*) FROM instruction) AS total FROM instruction ORDER BY address LIMIT 2000 OFFSET 500",
    "cfg_leaders": f"WITH {_CFG} SELECT DISTINCT fn, address FROM ld",
    "cfg_blocks": f"WITH {_CFG} SELECT fn, CAST(block AS BIGINT) AS block, min(address) AS start_addr, max(address) AS end_addr, count(*) AS n FROM bk GROUP BY fn, block",
    "cfg_edges": f"WITH {_CFG} SELECT fn, CAST(from_block AS BIGINT) AS from_block, CAST(to_block AS BIGINT) AS to_block, edge_type, comment FROM e",
    "cfg_preds": f"WITH {_CFG} SELECT fn, CAST(to_block AS BIGINT) AS block, array_to_string(list_sort(list(DISTINCT CAST(from_block AS BIGINT))), ',') AS preds FROM e WHERE to_block >= 0 GROUP BY fn, to_block",
    "cfg_stats": f"""WITH {_CFG}, b AS (SELECT fn, CAST(arg_min(block, address) AS BIGINT) AS entry_block, count(*) AS instructions, count(DISTINCT block) AS blocks FROM bk GROUP BY fn), x AS (SELECT fn, count(*) AS edges, count(*) FILTER (WHERE edge_type = 'call') AS calls FROM e GROUP BY fn)
SELECT b.fn, entry_block, instructions, blocks, coalesce(edges, 0) AS edges, coalesce(calls, 0) AS calls FROM b LEFT JOIN x USING (fn)""",
    "branch_targets": f"WITH {_CFG} SELECT DISTINCT k.fn, k.target AS address FROM k JOIN k j ON j.fn = k.fn AND j.address = k.target",
    "unknown_calls": f"WITH {_CFG} SELECT fn, address, target FROM k WHERE kind = 'call' AND target NOT IN (SELECT min(address) FROM k GROUP BY fn)",
}
