"""Queries on the code index, signatures, images, replies, streams and whole analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardlens.functions import text as T
from boardlens.functions import vocabulary as V
from boardlens.operators import analysis
from boardlens.operators import diagnosis as D
from boardlens.operators import images as M
from boardlens.operators import index as I
from boardlens.operators import logs as L
from boardlens.operators import signatures as G
from boardlens.sources import fixtures as X
from boardlens.plans.code import _P as _SETS
from boardlens.plans.code import _FOUND
from boardlens.plans.logs import _P as _FIRST
from boardlens.streaming import jobs


def _documents(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select(F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"))


def _queries(spark, sf_dir):
    b = X.table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark, sf_dir, queries=None):
    return I.build(I.chunks(X.code_files(spark, sf_dir)), queries=queries)


def token_estimates(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.estimate_by_characters(F.col("text")).alias("by_characters"), T.estimate_by_runs(F.col("text")).alias("by_runs"), T.cjk_share(F.col("text")).alias("cjk"))


def chunk_lines(spark, sf_dir):
    return I.line_chunks(_documents(spark, sf_dir)).select("chunk_id", "file_path", "line_start", "line_end", F.md5("content").alias("content_md5"), "language")


def chunk_functions(spark, sf_dir):
    return I.function_chunks(X.code_files(spark, sf_dir)).select("chunk_id", "file_path", "function_name", "line_start", "line_end", F.md5("content").alias("content_md5"), "language")


def word_statistics(spark, sf_dir):
    own = _documents(spark, sf_dir).select(F.col("file_path").alias("chunk_id"), "content")
    return I.word_statistics(I.postings(own)).select("word", "df", F.round("idf", 9).alias("idf"))


def index_statistics(spark, sf_dir):
    files = X.code_files(spark, sf_dir)
    s = I.statistics(files, I.chunks(files))
    return s.select("total_files", "total_chunks", "total_lines", "total_bytes", "megabytes", F.to_json("languages").alias("languages"))


def bm25(spark, sf_dir):
    queries = _queries(spark, sf_dir)
    s = I.scores(_index(spark, sf_dir, queries), queries, words=False)
    return s.select("query_id", "chunk_id", "file_path", F.round("score", 6).alias("score"), F.col("n_matched").alias("matched"))


def retrieve(spark, sf_dir):
    queries = _queries(spark, sf_dir)
    return I.search(_index(spark, sf_dir, queries), queries).select("query_id", F.col("rank").cast("long").alias("rank"), "file_path", "chunk_id", "score", "label", "tokens")


def log_set_analysis(spark, sf_dir):
    """Each board and day of events as a log set, with code from documents, answered by rule."""
    lines = X.log_lines(spark, sf_dir).select(F.col("file").alias("set_id"), F.col("line_number").alias("n"), F.col("raw").alias("line"))
    got = analysis.analyze_sets(lines, _index(spark, sf_dir))
    return got.select("set_id", "severity", "error_type", "n_chunks", F.get("chunks.file_path", F.lit(0)).alias("first_file"), "root_cause", "suggestion", "success", "call_ok")


def analysis_report(spark, sf_dir):
    lines = X.log_lines(spark, sf_dir).select(F.col("file").alias("set_id"), F.col("line_number").alias("n"), F.col("raw").alias("line"))
    return analysis.batch_report(analysis.analyze_sets(lines, None))


def query_tokens(spark, sf_dir):
    return _queries(spark, sf_dir).select("query_id", F.explode(T.query_words(F.col("query"))).alias("word"))


def _signature_lines(spark, sf_dir):
    p = X.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("seq"), F.format_string("0x%04x fn_%d %d // part", F.col("p_partkey") % 512, "p_partkey", F.col("p_size") % 4).alias("line"))


def signature_text(spark, sf_dir):
    return G.parse_text(_signature_lines(spark, sf_dir))


def signature_match(spark, sf_dir):
    functions = X.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("fn"), (F.col("s_suppkey") * 7 % 600).alias("crc16"))
    return G.match(functions, G.parse_text(_signature_lines(spark, sf_dir)))


def head_checksums(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return d.select("doc_id", G.head_checksum(F.col("text").cast("binary"), F.lit(0)).alias("crc16"))


def _images(spark, sf_dir):
    return M.parse_images(X.image_files(spark, sf_dir))


def elf_symbols(spark, sf_dir):
    return M.symbols(_images(spark, sf_dir)).select("image", "seq", "name", F.col("start").cast("long").alias("start"), "size")


def image_metadata(spark, sf_dir):
    return M.metadata(_images(spark, sf_dir)).select("path", "arch", "bits", F.col("entry").cast("long").alias("entry"), F.col("code_size").cast("long").alias("code_size"), F.col("n_symbols").cast("long").alias("n_symbols"), F.col("error").isNotNull().alias("failed"))


def function_detect(spark, sf_dir):
    return M.detect_functions(_images(spark, sf_dir))


def analyze_functions(spark, sf_dir):
    """Functions of the derived images, named by signatures of which one in nine part keys has one."""
    got = M.analyze_functions(X.image_files(spark, sf_dir), _library(spark, sf_dir))
    return got.select("path", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "size", "name", "is_library", "is_thumb", "arch_mode", "confidence")


def _library(spark, sf_dir):
    """Signatures for the code of every ninth part key, from the same bytes."""
    p = X.table(spark, sf_dir, "part").where("p_partkey % 9 = 0")

    @F.arrow_udf("binary")
    def code(keys):
        import pyarrow as pa

        return pa.array([X.code_of(k)[: G.HEAD_BYTES] for k in keys.to_pylist()], pa.binary())

    return p.select(F.col("p_partkey").alias("seq"), F.concat(F.lit("lib_"), F.col("p_partkey").cast("string")).alias("name"), G.fold(F.crc32(code("p_partkey"))).alias("crc16"), (F.col("p_partkey") % 2).alias("flags"))


def function_ends(spark, sf_dir):
    return M.function_ends(X.instructions(spark, sf_dir))


def _replies(spark, sf_dir):
    """Replies of four kinds around the turns of conversations."""
    t = X.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("t"))
    fenced = F.concat(F.lit("## ANALYSIS\n```c\nint before;\n```\n"), F.col("t"), F.lit("\n\n## DIFF\n```diff\n\n```\n```diff\n--- a/x.c\n+++ b/x.c\n-"), F.col("turn").cast("string"), F.lit("\n```\n"))
    loose = F.concat(F.lit("\t"), F.col("t"), F.lit("\n\t--- a/y.c\n\t+++ b/y.c\n+"), F.col("turn").cast("string"), F.lit("\nend"))
    whole = F.to_json(F.struct(F.lit("stack overflow").alias("root_cause"), F.col("t").alias("suggestion"), F.lit("none").alias("patch")))
    k = (F.col("conv_id") + F.col("turn")) % 4
    return t.select("conv_id", "turn", F.when(k == 0, fenced).when(k == 1, loose).when(k == 2, whole).otherwise(F.col("t")).alias("text"))


def reply_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", D.parse_reply(F.col("text")).alias("r")).select("conv_id", "turn", "r.*")


def patch_names(spark, sf_dir):
    s = X.table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", D.patch_name(F.col("s_name"), F.lit("20240101")).alias("name"))


def diagnoses(spark, sf_dir):
    e = L.error_context(X.log_lines(spark, sf_dir))
    return D.diagnosed(e).select("file", "root_cause", "suggestion", "success")


def stream_tables(spark, sf_dir):
    """The tables that the stream writes for each batch of files, here for all files as one batch."""
    rows = X.log_lines(spark, sf_dir).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_number", "raw"))), lambda s: s["raw"]), "\n").alias("content"))
    tables = jobs.tables_of(rows, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return tables["error_context"].select("file", "device", "line_number", "error_type", "first_line")


QUERIES = {
    f.__name__: f
    for f in (
        token_estimates, chunk_lines, chunk_functions, word_statistics, index_statistics, bm25, retrieve, log_set_analysis, analysis_report, query_tokens, signature_text, signature_match,
        head_checksums, elf_symbols, image_metadata, function_detect, analyze_functions, function_ends, reply_parse, patch_names, diagnoses, stream_tables,
    )
}

_WORDS = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-z_][a-z0-9_]{{2,}}'))"
_STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"
_STARTS = [p.replace("'", "''") for p in V.FUNCTION_STARTS]
_FIRST_LINE = " ".join(rf"WHEN regexp_matches(l[1], '^{p.removeprefix(chr(94) + chr(92) + 's*')}') THEN {k}" for k, p in enumerate(_STARTS))
_ANY_LINE = " ".join(f"WHEN len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) > 0 THEN {k}" for k, p in enumerate(_STARTS))
_NAME = " ".join(f"WHEN {k} THEN regexp_extract(l[i], '{p}', 1)" for k, p in enumerate(_STARTS))
_LANGUAGE = "CASE ext WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' ELSE ext END"


def _split(source: str) -> str:
    """Lines of files that are not blank, and whether the last one ends."""
    return f"SELECT *, CASE WHEN ends_with(content, chr(10)) THEN string_split(content[:-2], chr(10)) ELSE string_split(content, chr(10)) END AS l, ends_with(content, chr(10)) AS nl FROM {source} WHERE {_STRIP.format(x='content')} <> ''"


_PART = "array_to_string(l[a:z], chr(10)) || CASE WHEN z < len(l) OR nl THEN chr(10) ELSE '' END"
#: Chunks of code: by functions, else windows of 51 lines, one for each line.
_CHUNKS = f"""{X.CODE_FILES},
fl AS ({_split('code_file')}),
pk AS (SELECT *, CASE {_FIRST_LINE} {_ANY_LINE} END AS pick FROM fl WHERE len(l) >= 5),
sn AS (SELECT * FROM (SELECT file_path, ext, l, nl, i, CASE pick {_NAME} END AS name FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM pk WHERE pick IS NOT NULL)) WHERE name <> ''),
fe AS (SELECT * FROM (SELECT file_path, ext, a, z, name, {_PART} AS content FROM (SELECT *, i AS a, coalesce(lead(i) OVER (PARTITION BY file_path ORDER BY i) - 1, len(l)) AS z FROM sn)) WHERE length({_STRIP.format(x='content')}) >= 20),
lw AS (SELECT file_path, ext, a, z, 'chunk_' || CAST(a - 1 AS VARCHAR) AS name, {_PART} AS content FROM (SELECT *, least(a + 50, len(l)) AS z FROM (SELECT *, unnest(range(1, len(l) + 1)) AS a FROM fl ANTI JOIN fe USING (file_path)))),
ch AS (SELECT substr(md5(file_path || ':' || CAST(a AS VARCHAR) || ':' || name), 1, 16) AS chunk_id, file_path, CAST(a AS BIGINT) AS line_start, CAST(z AS BIGINT) AS line_end, content, fn AS function_name, {_LANGUAGE} AS language FROM (SELECT *, name AS fn FROM fe UNION ALL SELECT *, NULL FROM lw))"""


def _scored(queries: str) -> str:
    """Scores of chunks for queries (query_id, query)."""
    return rf"""{_CHUNKS},
w AS (SELECT chunk_id, unnest({_WORDS.format(t="content")}) AS word FROM ch), po AS (SELECT chunk_id, word, count(*) AS tf FROM w GROUP BY ALL),
st AS (SELECT word, CASE WHEN count(*) > 1 THEN 0.5 + 0.5 * count(*) / (count(*) - 1) ELSE 0.5 END AS idf FROM po GROUP BY word),
q AS ({queries}), qw AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest({_WORDS.format(t="query")}) AS word FROM q)),
dl AS (SELECT chunk_id, file_path, len(regexp_extract_all(content, '\S+')) AS dl FROM ch), me AS (SELECT avg(dl) AS me FROM dl),
hi AS (SELECT query_id, chunk_id, word, tf, idf FROM po JOIN qw USING (word) JOIN st USING (word)),
na AS (SELECT query_id, chunk_id, word, function_name FROM qw JOIN (SELECT chunk_id, lower(function_name) AS function_name FROM ch WHERE function_name IS NOT NULL) ON contains(function_name, word)),
ev AS (SELECT * FROM hi UNION ALL SELECT query_id, chunk_id, word, 0, coalesce(idf, 0.5) FROM na LEFT JOIN st USING (word) WHERE list_contains(string_split(function_name, '_'), word) AND NOT EXISTS (SELECT 1 FROM hi WHERE hi.query_id = na.query_id AND hi.chunk_id = na.chunk_id)),
s0 AS (SELECT query_id, chunk_id, file_path, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / me)) + CASE WHEN word IN ('error', 'fail', 'exception', 'crash', 'bug', 'fix', 'warn') THEN 3.0 ELSE 0.0 END) AS score, list_sort(list(word)) AS words FROM ev JOIN dl USING (chunk_id), me GROUP BY ALL),
sc AS (SELECT s0.*, score + 5.0 * coalesce(k, 0) AS total FROM s0 LEFT JOIN (SELECT query_id, chunk_id, count(*) AS k FROM na GROUP BY ALL) USING (query_id, chunk_id))"""


def _found(queries: str) -> str:
    """The walk under a budget of 8192 tokens, ten files at most."""
    return rf"""{_scored(queries)},
be AS (SELECT query_id, file_path, max(round(total, 9)) AS score, arg_max(words, (round(total, 9), chunk_id)) AS words FROM sc GROUP BY ALL),
hc AS (SELECT query_id, be.file_path, score, chunk_id, (2 * length(content) - len(regexp_extract_all(content, '[a-zA-Z0-9_ 	.,;:]+'))) // 4 AS tokens,
row_number() OVER (PARTITION BY query_id, be.file_path ORDER BY len(list_filter(words, lambda x: contains(lower(content), x))) DESC, line_start) AS k FROM be JOIN ch USING (file_path)),
wk AS (SELECT query_id, list({{'used': tokens, 'n': 0, 'kept': [{{'f': file_path, 'c': chunk_id, 's': score, 't': tokens}}]}} ORDER BY score DESC, file_path) AS w FROM hc WHERE k = 1 AND tokens <= 8192 GROUP BY query_id),
fo AS (SELECT query_id, list_reduce(w, lambda a, x: CASE WHEN a.n < 10 AND a.used + x.used <= 8192 THEN {{'used': a.used + x.used, 'n': a.n + 1, 'kept': a.kept || x.kept}} ELSE a END, {{'used': w[1].used * 0, 'n': 0, 'kept': w[1].kept[2:1]}}).kept AS kept FROM wk),
re AS (SELECT query_id, i AS rank, kept[i].f AS file_path, kept[i].c AS chunk_id, kept[i].s AS score, kept[i].t AS tokens FROM (SELECT query_id, kept, unnest(range(1, len(kept) + 1)) AS i FROM fo))"""


_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
_INDEX = rf"""
w AS (SELECT doc_id, source, unnest({_WORDS.format(t="text")}) AS word FROM documents), po AS (SELECT source, doc_id, word, count(*) AS tf FROM w GROUP BY ALL),
st AS (SELECT word, count(*) AS df, CASE WHEN count(*) > 1 THEN 0.5 + 0.5 * count(*) / (count(*) - 1) ELSE 0.5 END AS idf FROM po GROUP BY word)"""
_SET_QUERY = f"{_FOUND}, sq AS (SELECT u.*, array_to_string([error_type, device] || coalesce(adr[1:3], []) || coalesce(locs[1:5], []) || [substr(summary, 1, 200)], ' ') AS query FROM u LEFT JOIN b USING (set_id))"
#: What the model by rule says of a set: the word that comes first in device, type, severity, summary and the first 30 lines.
_SAID = f"""lo AS (SELECT set_id, string_agg(line, chr(10) ORDER BY n) AS body FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY n) AS place FROM l) WHERE place <= 30 GROUP BY set_id),
pr AS (SELECT s.*, lower(device || ' | ' || error_type || ' | ' || severity || ' ' || summary || ' ' || body) AS prompt FROM sq s JOIN lo USING (set_id)),
ca AS (SELECT set_id, cause, instr(prompt, word) AS pos FROM pr, (VALUES {', '.join(f"('{w}', '{c}')" for w, c in D.CAUSES.items())}) t(word, cause)),
rc AS (SELECT pr.*, coalesce(cause, '{D.NO_CAUSE}') AS root_cause FROM pr LEFT JOIN (SELECT set_id, arg_min(cause, pos) AS cause FROM ca WHERE pos > 0 GROUP BY set_id) USING (set_id))"""
_CONTEXT_WORDS = ", ".join(f"('{w}', '{c}')" for w, c in D.CAUSES.items())
ORACLE = {
    "stream_tables": f"WITH {_FIRST} SELECT * FROM f",
    "token_estimates": r"""SELECT doc_id, CAST((2 * length(text) - len(regexp_extract_all(text, '[a-zA-Z0-9_ \t.,;:\-+=]'))) // 4 AS BIGINT) AS by_characters,
CAST((len(regexp_extract_all(text, '[a-zA-Z0-9_ \t.,;:]+')) + 2 * len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) + 2 * (length(text) - len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) - len(regexp_extract_all(text, '[a-zA-Z0-9_ \t.,;:]+')))) // 4 AS BIGINT) AS by_runs,
len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / greatest(length(text), 1) AS cjk FROM documents""",
    "chunk_lines": f"WITH d AS (SELECT source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file_path, text AS content FROM documents), f AS ({_split('d')}), c AS (SELECT *, least(a + 50, len(l)) AS z FROM (SELECT *, unnest(range(1, len(l) + 1)) AS a FROM f)) SELECT substr(md5(file_path || ':' || CAST(a AS VARCHAR) || ':chunk_' || CAST(a - 1 AS VARCHAR)), 1, 16) AS chunk_id, file_path, CAST(a AS BIGINT) AS line_start, CAST(z AS BIGINT) AS line_end, md5({_PART}) AS content_md5, 'txt' AS language FROM c",
    "chunk_functions": f"WITH {_CHUNKS} SELECT chunk_id, file_path, function_name, line_start, line_end, md5(content) AS content_md5, language FROM ch WHERE function_name IS NOT NULL",
    "index_statistics": f"""WITH {_CHUNKS}, n AS (SELECT {_LANGUAGE} AS language, count(*) AS n, sum(strlen(content)) AS size FROM code_file WHERE file_path IN (SELECT file_path FROM ch) GROUP BY ALL)
SELECT (SELECT count(*) FROM code_file) AS total_files, count(*) AS total_chunks, CAST(sum(line_end - line_start + 1) AS BIGINT) AS total_lines, (SELECT CAST(sum(size) AS BIGINT) FROM n) AS total_bytes, (SELECT round(sum(size) / 1048576, 2) FROM n) AS megabytes,
(SELECT '{{' || string_agg('"' || language || '":' || CAST(n AS VARCHAR), ',' ORDER BY language) || '}}' FROM n) AS languages FROM ch""",
    "word_statistics": f"WITH {_INDEX} SELECT word, df, round(idf, 9) AS idf FROM st",
    "bm25": f"WITH {_scored(_ASKED)} SELECT query_id, chunk_id, file_path, round(total, 6) AS score, CAST(len(words) AS BIGINT) AS matched FROM sc",
    "retrieve": f"WITH {_found(_ASKED)} SELECT query_id, rank, file_path, chunk_id, round(score, 2) AS score, CASE WHEN score > 20 THEN 'core' WHEN score > 5 THEN 'related' ELSE 'peripheral' END AS label, CAST(tokens AS BIGINT) AS tokens FROM re",
    "log_set_analysis": f"""WITH {_SET_QUERY}, {_SAID}, {_found('SELECT set_id AS query_id, query FROM sq')}
SELECT rc.set_id, severity, error_type, coalesce(n, 0) AS n_chunks, first_file, root_cause, root_cause || '. {D.LOOK}' AS suggestion, true AS success, true AS call_ok
FROM rc LEFT JOIN (SELECT query_id AS set_id, count(*) AS n, arg_min(file_path, rank) AS first_file FROM re GROUP BY query_id) USING (set_id)""",
    "analysis_report": f"WITH {_SETS} SELECT count(*) AS total, count(*) AS succeeded, 0 AS failed, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical, count(*) FILTER (WHERE severity = 'WARNING') AS warning, count(*) FILTER (WHERE severity = 'INFO') AS info FROM u",
    "query_tokens": f"SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format(t='text')}) AS word FROM benchmark",
    "signature_text": "SELECT p_partkey AS seq, 'fn_' || CAST(p_partkey AS VARCHAR) AS name, p_partkey % 512 AS crc16, CAST(p_size % 4 AS BIGINT) AS flags FROM part",
    "signature_match": """WITH s AS (SELECT p_partkey % 512 AS crc16, 'fn_' || CAST(p_partkey AS VARCHAR) AS signature, (p_size % 4) & 1 = 1 AS public, (p_size % 4) & 2 <> 0 AS weak, row_number() OVER (PARTITION BY p_partkey % 512 ORDER BY (p_size % 4) & 1 DESC, p_partkey) AS k FROM part)
SELECT s_suppkey AS fn, s_suppkey * 7 % 600 AS crc16, signature, public, weak FROM supplier LEFT JOIN (SELECT * FROM s WHERE k = 1) t ON t.crc16 = s_suppkey * 7 % 600""",
    "elf_symbols": f"""SELECT 'image_' || CAST(k AS VARCHAR) || '.elf' AS image, place AS seq, p_name || '_' || CAST(p_partkey AS VARCHAR) AS name, {X.BASE} + {X.SPACING * X.PER_IMAGE} * k + {X.SPACING} * (place - 1) AS start, CAST(p_size AS BIGINT) AS size
FROM (SELECT *, p_partkey // {X.PER_IMAGE} AS k, row_number() OVER (PARTITION BY p_partkey // {X.PER_IMAGE} ORDER BY p_partkey) AS place FROM part) WHERE k % 5 < 3""",
    "image_metadata": f"""SELECT 'image_' || CAST(k AS VARCHAR) || CASE k % 5 WHEN 3 THEN '.bin' ELSE '.elf' END AS path, CASE WHEN k % 5 = 3 THEN 'unknown' WHEN k % 5 = 4 THEN 'arm' ELSE 'arm' END AS arch, CAST(CASE WHEN k % 5 <> 3 THEN 32 END AS INTEGER) AS bits,
CASE k % 5 WHEN 3 THEN 0 ELSE {X.BASE} + {X.SPACING * X.PER_IMAGE} * k END AS entry, CASE WHEN k % 5 = 4 THEN 0 ELSE {X.SPACING} * n END AS code_size, CASE WHEN k % 5 < 3 THEN n ELSE 0 END AS n_symbols, k % 5 >= 3 AS failed
FROM (SELECT p_partkey // {X.PER_IMAGE} AS k, count(*) AS n FROM part GROUP BY ALL)""",
    "function_detect": f"""WITH p AS (SELECT p_partkey, p_partkey // {X.PER_IMAGE} AS k, row_number() OVER (PARTITION BY p_partkey // {X.PER_IMAGE} ORDER BY p_partkey) - 1 AS j, count(*) OVER (PARTITION BY p_partkey // {X.PER_IMAGE}) AS n FROM part),
s AS (SELECT k, n, {X.SPACING} * j AS place, 'symbol' AS source FROM p WHERE k % 5 < 3 UNION ALL SELECT k, n, {X.SPACING} * j + {X.SPACING // 2}, 'prologue' FROM p WHERE k % 5 < 3 AND p_partkey % 3 = 0)
SELECT 'image_' || CAST(k AS VARCHAR) || '.elf' AS path, place AS "offset", coalesce(lead(place) OVER (PARTITION BY k ORDER BY place), {X.SPACING} * n) AS "end", source FROM s""",
    "function_ends": f"WITH {X.INSTRUCTIONS} SELECT fn, min(address) AS start, coalesce(min(address) FILTER (WHERE mnemonic = 'pop'), max(address)) AS \"end\" FROM instruction GROUP BY fn",
    "reply_parse": rf"""WITH t AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id + turn) % 4 AS k FROM conversations),
a AS (SELECT *, CASE k WHEN 0 THEN '```c' || chr(10) || 'int before;' || chr(10) || '```' || chr(10) || t WHEN 1 THEN t || chr(10) || chr(9) || '--- a/y.c' || chr(10) || chr(9) || '+++ b/y.c' || chr(10) || '+' || CAST(turn AS VARCHAR) || chr(10) || 'end' ELSE t END AS whole FROM t),
b AS (SELECT *, {_STRIP.format(x="whole")} AS analysis FROM a)
SELECT conv_id, turn, CASE k WHEN 2 THEN 'stack overflow' ELSE {_STRIP.format(x="split_part(analysis, '.', 1)")} END AS root_cause, CASE k WHEN 2 THEN t ELSE analysis END AS suggestion,
CASE k WHEN 0 THEN '--- a/x.c' || chr(10) || '+++ b/x.c' || chr(10) || '-' || CAST(turn AS VARCHAR) WHEN 1 THEN chr(9) || '--- a/y.c' || chr(10) || chr(9) || '+++ b/y.c' || chr(10) || '+' || CAST(turn AS VARCHAR) || chr(10) || 'end' WHEN 2 THEN 'none' END AS patch FROM b""",
    "patch_names": r"SELECT s_suppkey, regexp_replace(s_name, '[^\p{L}\p{N}]', '_', 'g') || '_20240101.patch' AS name FROM supplier",
    "diagnoses": f"""WITH {_FIRST}, pr AS (SELECT file, lower(error_type || ' ' || first_line) AS prompt FROM f), ca AS (SELECT file, cause, instr(prompt, word) AS pos FROM pr, (VALUES {_CONTEXT_WORDS}) t(word, cause))
SELECT file, root_cause, root_cause || '. {D.LOOK}' AS suggestion, true AS success FROM (SELECT file, arg_min(cause, pos) AS root_cause FROM ca WHERE pos > 0 GROUP BY file)""",
}
