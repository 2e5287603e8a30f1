"""All queries outside the training-data subpackage, by name, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern import embedders
from quern.functions import text as X
from quern.operators import catalog as C
from quern.operators import chunking as K
from quern.operators import fusion as H
from quern.operators import lexicon as L
from quern.operators import ranking as R
from quern.operators import status as S
from quern.operators import vectors as V
from quern.plans import corpus as D
from quern.sources import readers
from quern.streaming import incremental

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


# --- Catalog: filters, roots, snapshots -------------------------------------------------------------------------

EXT = "CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.md' WHEN 2 THEN '.png' WHEN 3 THEN '.log' ELSE '' END"


def _varied(spark, sf):
    """Files with varied suffixes and folders."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".TXT", ".md", ".png", ".log", "")]), (F.col("doc_id") % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in ("a", "node_modules", ".git", "b/node_modules")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return D.files(spark, sf).withColumn("path", F.concat("directory", F.lit("/"), folder, F.lit("/f"), F.col("doc_id").cast("string"), ext))


VARIED = f"{D.FILES}, varied AS (SELECT * REPLACE (directory || '/' || (['a','node_modules','.git','b/node_modules'])[doc_id % 4 + 1] || '/f' || doc_id || ({EXT}) AS path) FROM files)"


@query("catalog_extension_filter", rf"WITH {VARIED} SELECT path, size FROM varied WHERE lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) IN ('.txt', '.md')")
def _(spark, sf):
    return C.wanted_suffix(_varied(spark, sf), (".txt", ".md")).select("path", "size")


@query("skip_component_filter", f"WITH {VARIED} SELECT path FROM varied WHERE NOT list_has_any(string_split(path, '/')[3:-2], ['node_modules', '.git'])")
def _(spark, sf):
    return C.outside_skipped(_varied(spark, sf), D.ROOT, ("node_modules", ".git")).select("path")


@query("image_size_gate", rf"WITH {VARIED} SELECT path, size * 4 AS size FROM varied WHERE lower(regexp_extract(path, '[^/](\.[^./]+)$', 1)) <> '.png' OR (size * 4 >= 8192 AND directory IN ('/corpus/src1', '/corpus/src2', '/corpus/src3'))")
def _(spark, sf):
    f = _varied(spark, sf).withColumn("size", F.col("size") * 4)
    return C.image_gate(f, [f"{D.ROOT}/src{k}" for k in (1, 2, 3)]).select("path", "size")


@query("prefix_scoped_scan", f"WITH {D.CHUNKS} SELECT chunk_id, file_path FROM chunks WHERE starts_with(file_path, '/corpus/src1/')")
def _(spark, sf):
    return D.chunks(spark, sf).where(C.under(F.col("file_path"), "/corpus/src1")).select("chunk_id", "file_path")


@query("prefix_sibling_guard", f"WITH {D.FILES} SELECT directory, count(*) AS files FROM files WHERE starts_with(path, '/corpus/src1/') GROUP BY directory")
def _(spark, sf):
    return D.files(spark, sf).where(C.under(F.col("path"), "/corpus/src1/")).groupBy("directory").agg(F.count("*").alias("files"))


@query("root_overlap_last_wins", f"WITH {D.FILES} SELECT path, CASE WHEN doc_id % 3 = 0 THEN '/corpus' ELSE directory END AS directory FROM files")
def _(spark, sf):
    f = D.files(spark, sf)
    return C.merged_roots([f, f.where("doc_id % 3 = 0").withColumn("directory", F.lit(D.ROOT))]).select("path", "directory")


DIFF = """SELECT path, CASE WHEN s.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' WHEN s.mtime_ns IS NOT DISTINCT FROM c.mtime_ns AND s.size = c.size THEN 'same' ELSE 'changed' END AS action
FROM stored s FULL JOIN current c USING (path)"""


@query("snapshot_diff", f"WITH {D.SNAPSHOTS} {DIFF}")
def _(spark, sf):
    return C.snapshot_diff(*D.snapshots(spark, sf))


@query("snapshot_full_rebuild", f"WITH {D.SNAPSHOTS} SELECT path, CASE WHEN s.path IS NULL THEN 'new' WHEN c.path IS NULL THEN 'removed' ELSE 'changed' END AS action FROM stored s FULL JOIN current c USING (path)")
def _(spark, sf):
    return C.snapshot_diff(*D.snapshots(spark, sf), full=True)


@query("snapshot_protected_roots", f"WITH {D.SNAPSHOTS}, d AS ({DIFF}) SELECT path, CASE WHEN action = 'removed' AND starts_with(path, '/corpus/src2/') THEN 'same' ELSE action END AS action FROM d")
def _(spark, sf):
    stored, current = D.snapshots(spark, sf)
    return C.snapshot_diff(stored, current, protect=spark.createDataFrame([("/corpus/src2",)], "directory string"))


@query("survivors_after_delete", f"WITH {D.SNAPSHOTS}, {D.CHUNKS}, d AS ({DIFF}) SELECT chunk_id, file_path FROM chunks WHERE file_path NOT IN (SELECT path FROM d WHERE action IN ('changed', 'removed'))")
def _(spark, sf):
    return C.survivors(D.chunks(spark, sf), C.snapshot_diff(*D.snapshots(spark, sf))).select("chunk_id", "file_path")


@query("refreshed_chunks", f"WITH {D.SNAPSHOTS}, {D.CHUNKS}, d AS ({DIFF}) SELECT chunk_id, action FROM chunks JOIN d ON path = file_path WHERE action <> 'removed'")
def _(spark, sf):
    diff, chunks = C.snapshot_diff(*D.snapshots(spark, sf)), D.chunks(spark, sf)
    kept = C.survivors(chunks, diff).join(diff, F.col("file_path") == F.col("path"))
    added = chunks.join(diff.where(F.col("action").isin("new", "changed")), F.col("file_path") == F.col("path"))
    return kept.where("action = 'same'").select("chunk_id", "action").unionByName(added.select("chunk_id", "action"))


@query("remove_root", f"WITH {D.FILES}, {D.CHUNKS} SELECT chunk_id FROM chunks WHERE file_path NOT IN (SELECT path FROM files WHERE directory = '/corpus/src3')")
def _(spark, sf):
    return C.without_root(D.chunks(spark, sf), D.files(spark, sf), C.root_named([f"{D.ROOT}/src{k}" for k in range(20)], "/src3")).select("chunk_id")


@query("retry_marks", f"WITH {D.FILES}, {D.CHUNKS} SELECT path, CASE WHEN path IN (SELECT file_path FROM chunks WHERE chunk_id % 29 = 0) THEN -1 ELSE mtime_ns END AS mtime_ns FROM files")
def _(spark, sf):
    failed = D.chunks(spark, sf).where("chunk_id % 29 = 0").select("chunk_id")
    return C.marked_for_retry(D.files(spark, sf), D.chunks(spark, sf), failed).select("path", "mtime_ns")


@query("retry_files", f"WITH {D.CHUNKS} SELECT DISTINCT file_path FROM chunks WHERE chunk_id % 29 = 0")
def _(spark, sf):
    c = D.chunks(spark, sf)
    return c.join(c.where("chunk_id % 29 = 0").select("chunk_id"), "chunk_id", "left_semi").select("file_path").distinct()


@query("model_change_invalidation", "SELECT 'same' AS model, count(*) AS kept FROM embeddings UNION ALL SELECT 'other', 0")
def _(spark, sf):
    v, m = D.vectors(spark, sf), D.meta(spark)
    one = lambda model, name: C.after_model_change(v, m, model).agg(F.count("*").alias("kept")).select(F.lit(name).alias("model"), "kept")
    return one("hash-8", "same").unionByName(one("hash-16", "other"))


@query("truncation_check", "SELECT 4000 AS made_with, (SELECT count(*) FROM embeddings) > 0 AS warn")
def _(spark, sf):
    return C.truncation_warning(C.upserted(D.meta(spark), "key", "written"), D.vectors(spark, sf))


@query("upsert_latest_wins", f"WITH {D.META} SELECT key, arg_max(value, written) AS value FROM meta GROUP BY key")
def _(spark, sf):
    return C.upserted(D.meta(spark), "key", "written").select("key", "value")


@query("snapshot_set_operations", f"WITH {D.SNAPSHOTS} SELECT path, 'gone' AS kind FROM (SELECT path FROM stored EXCEPT SELECT path FROM current) UNION ALL SELECT path, 'fresh' FROM (SELECT path FROM current EXCEPT SELECT path FROM stored)")
def _(spark, sf):
    s, c = (x.select("path") for x in D.snapshots(spark, sf))
    return s.subtract(c).withColumn("kind", F.lit("gone")).unionByName(c.subtract(s).withColumn("kind", F.lit("fresh")))


# --- Chunks ------------------------------------------------------------------------------------------------------

PACK = r"""p AS (SELECT path, text, list_filter(string_split_regex(text, '\n\n+'), lambda x: true) AS ps FROM src),
pack AS (
  WITH RECURSIVE r(path, i, k, cur) AS (
    SELECT path, 1, 0, ps[1] FROM p WHERE length(text) > 4000
    UNION ALL
    SELECT r.path, i + 1, CASE WHEN length(cur) + length(ps[i + 1]) + 2 <= 4000 THEN k ELSE k + 1 END,
           CASE WHEN length(cur) + length(ps[i + 1]) + 2 <= 4000 THEN cur || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END
    FROM r JOIN p USING (path) WHERE i < len(ps))
  SELECT path, k, regexp_replace(arg_max(cur, i), '^\s+|\s+$', '', 'g') AS content FROM r GROUP BY path, k
  UNION ALL SELECT path, 0, text FROM p WHERE length(text) <= 4000)"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query("pack_paragraphs", f"WITH {D.SPACED}, src AS (SELECT path, text FROM spaced), {PACK} SELECT path, k, length(content) AS n, sha256(content) AS digest FROM pack")
def _(spark, sf):
    d = D.spaced(spark, sf).select("path", F.posexplode(K.pack_paragraphs(F.col("text"))).alias("k", "content"))
    return d.select("path", F.col("k").cast("long").alias("k"), F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("digest"))


PLAIN = f"""WITH {D.SPACED}, src AS (SELECT path, {STRIP.format('text')} AS text FROM spaced), {PACK},
chunked AS (SELECT path AS file_path, row_number() OVER (PARTITION BY path ORDER BY k) - 1 AS chunk_index, content FROM pack WHERE length({STRIP.format('content')}) > 0)"""


@query("plain_chunks_dense_index", f"{PLAIN} SELECT file_path, chunk_index, sha256(content) AS digest FROM chunked")
def _(spark, sf):
    c = K.plain_chunks(D.spaced(spark, sf))
    return c.select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("content", 256).alias("digest"))


SECTIONS = rf"""{D.MARKDOWN},
cut AS (SELECT path, text, regexp_extract_all(text, '(?m)^#{{1,3}}\s+[^\n]+') AS marks, string_split_regex(text, '(?m)^#{{1,3}}\s+[^\n]+') AS bodies FROM md),
sec AS (SELECT path, unnest(range(len(bodies))) AS n, marks, bodies FROM cut),
lev AS (SELECT path, n, bodies[n + 1] AS body, CASE WHEN n > 0 THEN length(regexp_extract(marks[n], '^(#{{1,3}})', 1)) END AS level,
        CASE WHEN n > 0 THEN {STRIP.format("regexp_extract(marks[n], '^#{1,3}\\s+([^\\n]+)', 1)")} END AS title FROM sec),
win AS (SELECT *, max(CASE WHEN level = 1 THEN n END) OVER w AS n1, max(CASE WHEN level = 2 THEN n END) OVER w AS n2, max(CASE WHEN level = 3 THEN n END) OVER w AS n3
        FROM lev WINDOW w AS (PARTITION BY path ORDER BY n ROWS UNBOUNDED PRECEDING)),
crumbs AS (SELECT w.path, w.n, w.body, concat_ws(' > ', a.title, b.title, c.title) AS heading FROM win w
  LEFT JOIN lev a ON a.path = w.path AND a.n = w.n1
  LEFT JOIN lev b ON b.path = w.path AND b.n = w.n2 AND (w.n1 IS NULL OR w.n2 > w.n1)
  LEFT JOIN lev c ON c.path = w.path AND c.n = w.n3 AND (w.n1 IS NULL OR w.n3 > w.n1) AND (w.n2 IS NULL OR w.n3 > w.n2)),
kept AS (SELECT path, n, heading, {STRIP.format('body')} AS body FROM crumbs WHERE length({STRIP.format('body')}) > 0)"""


@query("heading_sections", f"WITH {SECTIONS} SELECT path, n, heading, sha256(body) AS digest FROM kept")
def _(spark, sf):
    d = D.markdown(spark, sf).select("path", F.posexplode(K.sections(F.col("text"))).alias("n", "s"))
    d = d.select("path", F.col("n").cast("long").alias("n"), F.col("s.heading").alias("heading"), X.strip(F.col("s.body")).alias("body"))
    return d.where(F.length("body") > 0).select("path", "n", "heading", F.sha2("body", 256).alias("digest"))


@query(
    "heading_then_pack",
    f"WITH {SECTIONS}, src AS (SELECT path || '#' || lpad(n::VARCHAR, 6, '0') AS path, body AS text FROM kept), {PACK} "
    "SELECT split_part(pack.path, '#', 1) AS file_path, row_number() OVER (PARTITION BY split_part(pack.path, '#', 1) ORDER BY pack.path, pack.k) - 1 AS chunk_index, heading, sha256(content) AS digest "
    "FROM pack JOIN kept ON pack.path = kept.path || '#' || lpad(n::VARCHAR, 6, '0')",
)
def _(spark, sf):
    c = K.markdown_chunks(D.markdown(spark, sf))
    return c.select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), "heading", F.sha2("content", 256).alias("digest"))


@query(
    "embed_text_overlap",
    f"{PLAIN}, w AS (SELECT *, lag(content) OVER (PARTITION BY file_path ORDER BY chunk_index) AS prev FROM chunked), "
    "e AS (SELECT file_path, chunk_index, left('Part: ' || CASE WHEN length(coalesce(prev, '')) > 0 THEN '...' || right(prev, 30) || chr(10) || chr(10) || content ELSE content END, 8000) AS x FROM w) "
    "SELECT file_path, chunk_index, length(x) AS n, sha256(x) AS digest FROM e",
)
def _(spark, sf):
    c = K.with_previous(K.plain_chunks(D.spaced(spark, sf))).withColumn("x", X.embed_text(F.lit("Part"), F.col("content"), F.col("previous"), 30))
    return c.select("file_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.length("x").cast("long").alias("n"), F.sha2("x", 256).alias("digest"))


@query("embed_eligibility", f"WITH {D.CHUNKS} SELECT chunk_id FROM chunks WHERE length({STRIP.format('content')}) >= 50")
def _(spark, sf):
    return D.chunks(spark, sf).where(F.length(X.strip(F.col("content"))) >= X.MIN_EMBED).select("chunk_id")


@query("embed_truncate", f"WITH {D.CHUNKS} SELECT chunk_id, least(length(content), 8000) AS n, sha256(left(content, 8000)) AS digest FROM chunks WHERE length(content) > 8000")
def _(spark, sf):
    c = D.chunks(spark, sf).where(F.length("content") > X.MAX_EMBED).withColumn("x", F.substring("content", 1, X.MAX_EMBED))
    return c.select("chunk_id", F.length("x").cast("long").alias("n"), F.sha2("x", 256).alias("digest"))


# --- Scalar functions --------------------------------------------------------------------------------------------


def _clip_sql(x: str, n: int) -> str:
    cut, back = f"left({x}, {n - 3})", f"instr(reverse(left({x}, {n - 3})), ' ')"
    kept = f"CASE WHEN {back} > 0 AND {n - 3} - {back} > {(n - 3) / 2} THEN left({cut}, {n - 3} - {back}) ELSE {cut} END"
    return rf"CASE WHEN length({x}) <= {n} THEN {x} ELSE regexp_replace({kept}, '\s+$', '') || '...' END"


@query("clip_words", f"SELECT doc_id, {_clip_sql('text', 5)} AS c5, {_clip_sql('text', 40)} AS c40, left(text, 3) AS c3 FROM documents")
def _(spark, sf):
    t = F.col("text")
    return D.table(spark, sf, "documents").select("doc_id", X.clip_words(t, 5).alias("c5"), X.clip_words(t, 40).alias("c40"), X.clip_words(t, 3).alias("c3"))


@query("semantic_snippet", f"WITH x AS (SELECT doc_id, replace(text, chr(10), ' ') AS t, text FROM documents) SELECT doc_id, {_clip_sql('t', 200)} AS snippet, {_clip_sql('text', 50)} AS short FROM x")
def _(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", X.semantic_snippet(F.col("text")).alias("snippet"), X.semantic_snippet(F.col("text"), 50).alias("short"))


@query("unbold_headings", r"WITH x AS (SELECT doc_id, '## **' || lang || ' title**  ' || chr(10) || text || chr(10) || '#### **x** y' AS t FROM documents) SELECT doc_id, regexp_replace(t, '(?m)^(#{1,6}\s+)\*\*(.+?)\*\*\s*$', '\1\2', 'g') AS t FROM x")
def _(spark, sf):
    t = F.concat(F.lit("## **"), "lang", F.lit(" title**  \n"), "text", F.lit("\n#### **x** y"))
    return D.table(spark, sf, "documents").select("doc_id", X.unbold_headings(t).alias("t"))


@query("strip_markup", r"SELECT page_id, sha256(regexp_replace(regexp_replace(html || '![a](b.png)', '!\[[^\]]*\]\([^)]*\)', '', 'g'), '</?[a-zA-Z][a-zA-Z0-9]*(\s[^<>]*)?/?>', '', 'g')) AS digest FROM pages")
def _(spark, sf):
    t = F.concat("html", F.lit("![a](b.png)"))
    return D.table(spark, sf, "pages").select("page_id", F.sha2(X.strip_tags(X.strip_images(t)), 256).alias("digest"))


@query("has_text", r"SELECT doc_id, length(regexp_replace(regexp_replace('![alt text that is long enough](x.png)' || text, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '[^\p{L}\p{N}_]', '', 'g')) >= 20 AS ok FROM documents")
def _(spark, sf):
    t = F.concat(F.lit("![alt text that is long enough](x.png)"), "text")
    return D.table(spark, sf, "documents").select("doc_id", X.has_text(t).alias("ok"))


@query(
    "query_terms",
    r"WITH x AS (SELECT item_id, 'foo_bar AND -no ' || text AS q FROM benchmark) SELECT item_id, array_to_string(flatten(list_transform(list_filter(string_split_regex(q, '\s+'), lambda w: w NOT IN ('AND', 'OR', 'NOT', 'NEAR') AND NOT starts_with(w, '-')), "
    r"lambda w: regexp_extract_all(w, '[\p{L}\p{N}_]+'))), '|') AS terms, true AS operators FROM x",
)
def _(spark, sf):
    q = F.concat(F.lit("foo_bar AND -no "), "text")
    return D.table(spark, sf, "benchmark").select("item_id", F.array_join(X.query_terms(q), "|").alias("terms"), X.has_operators(q).alias("operators"))


@query("mtime_iso", f"WITH {D.FILES} SELECT path, CASE WHEN mtime_ns >= 0 THEN strftime(make_timestamp(mtime_ns // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS mtime FROM files")
def _(spark, sf):
    return D.files(spark, sf).select("path", X.iso_time(F.col("mtime_ns")).alias("mtime"))


@query("int_with_default", "SELECT event_id, coalesce(TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'x' || event_id ELSE event_id::VARCHAR END AS INT), 2000) AS v FROM events")
def _(spark, sf):
    v = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("x"), F.col("event_id").cast("string"))).otherwise(F.col("event_id").cast("string"))
    return D.table(spark, sf, "events").select("event_id", X.int_or(v, 2000).alias("v"))


@query("data_url", "SELECT item_id, 'data:text/plain;base64,' || base64(encode(text)) AS url FROM benchmark")
def _(spark, sf):
    return D.table(spark, sf, "benchmark").select("item_id", X.data_url(F.col("text").cast("binary"), F.lit("text/plain")).alias("url"))


# --- Index -------------------------------------------------------------------------------------------------------


@query("token_counts", f"WITH {D.TOKENISED}, x AS (SELECT unnest(ct) AS term FROM t) SELECT term, count(*) AS n FROM x GROUP BY term")
def _(spark, sf):
    return D.searchable(spark, sf).select(F.explode("content_tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@query(
    "postings_with_positions",
    f"WITH {D.TOKENISED}, x AS (SELECT chunk_id, 'content' AS col, unnest(ct) AS term, unnest(range(len(ct))) AS pos FROM t UNION ALL SELECT chunk_id, 'heading', unnest(ht), unnest(range(len(ht))) FROM t) "
    "SELECT term, chunk_id, col, array_to_string(list(pos ORDER BY pos), ',') AS positions, count(*) AS tf FROM x GROUP BY term, chunk_id, col",
)
def _(spark, sf):
    p = L.postings(D.chunks(spark, sf))
    return p.select("term", "chunk_id", "col", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"), "tf")


@query("corpus_stats", f"WITH {D.TOKENISED} SELECT count(*) AS n, round(avg(len(ct) + len(ht)), 4) AS avgdl FROM t")
def _(spark, sf):
    return L.corpus_stats(L.document_lengths(D.chunks(spark, sf))).select("n", F.round("avgdl", 4).alias("avgdl"))


@query("term_df", f"WITH {D.TOKENISED}, x AS (SELECT chunk_id, unnest(list_concat(ct, ht)) AS term FROM t) SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM x GROUP BY term")
def _(spark, sf):
    return L.document_frequencies(D.chunks(spark, sf))


@query(
    "index_refresh",
    f"WITH {D.TOKENISED}, x AS (SELECT CASE WHEN chunk_id % 5 = 0 THEN 'again' ELSE 'kept' END AS kind, unnest(list_concat(ct, ht)) AS term FROM t WHERE chunk_id % 3 <> 0 OR chunk_id % 5 = 0) SELECT kind, count(*) AS n FROM x GROUP BY kind",
)
def _(spark, sf):
    c = D.chunks(spark, sf)
    gone = c.where("chunk_id % 3 = 0 or chunk_id % 5 = 0")
    new = L.refreshed(L.postings(c), gone, c.where("chunk_id % 5 = 0"))
    return new.groupBy(F.when(F.col("chunk_id") % 5 == 0, "again").otherwise("kept").alias("kind")).agg(F.sum("tf").alias("n"))


# --- Lexical search ----------------------------------------------------------------------------------------------


def _phrase(col: str, *words: str) -> str:
    """Occurrences of adjacent words in a token list."""
    if len(words) == 1:
        return f"len(list_filter({col}, lambda x: x = '{words[0]}'))"
    test = " AND ".join(f"{col}[i + {k}] = '{w}'" for k, w in enumerate(words))
    return f"len(list_filter(range(1, len({col}) - {len(words) - 2}), lambda i: {test}))"


def _both(*words: str) -> tuple[str, str]:
    return _phrase("ct", *words), _phrase("ht", *words)


def bm25_sql(phrases: list[tuple[str, str]], where: str, limit: int = 10, scope: str = "true", ranked: int | None = None) -> str:
    """BM25 over the phrases' (content, heading) occurrence expressions; `where` speaks of their sums p0, p1, ..."""
    n = len(phrases) if ranked is None else ranked
    hits = ", ".join(f"({c})::DOUBLE AS c{k}, ({h})::DOUBLE AS h{k}" for k, (c, h) in enumerate(phrases))
    sums = ", ".join(f"c{k} + h{k} AS p{k}" for k in range(len(phrases)))
    df = ", ".join(f"sum((c{k} + h{k} > 0)::INT)::DOUBLE AS df{k}" for k in range(n))
    score = " + ".join(f"greatest(ln((n - df{k} + 0.5) / (df{k} + 0.5)), 1e-6) * ((c{k} * 1.0 + h{k} * 2.0) * 2.2 / ((c{k} * 1.0 + h{k} * 2.0) + 1.2 * (0.25 + 0.75 * dl / avgdl)))" for k in range(n))
    return f"""WITH {D.TOKENISED}, q AS (SELECT *, {hits}, (len(ct) + len(ht))::DOUBLE AS dl FROM t), q2 AS (SELECT *, {sums} FROM q),
    st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl, {df} FROM q),
    s AS (SELECT chunk_id, file_path, {score} AS score FROM q2 CROSS JOIN st WHERE ({where}) AND ({scope}))
    SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id, file_path, round(score, 4) AS score FROM s ORDER BY score DESC, chunk_id LIMIT {limit}"""


def _ranked(rows):
    """Rank, id, path and score of rows that are already cut to the best few."""
    w = Window.orderBy(F.desc("score"), "chunk_id")
    return rows.select(F.row_number().over(w).cast("long").alias("rank"), "chunk_id", "file_path", F.round("score", 4).alias("score"))


def lexical(name: str, text: str, sql: str, limit: int = 10, prefix: str | None = None, ladder: bool = False, strict: bool = False):
    def run(spark, sf):
        index = D.indexed(spark, sf)
        return _ranked(index.search(text, limit, strict, prefix) if ladder else index.best(text, limit, prefix))

    QUERIES[name] = run
    ORACLE[name] = sql


NONE = "SELECT 0::BIGINT AS rank, 0::BIGINT AS chunk_id, '' AS file_path, 0.0::DOUBLE AS score WHERE false"
AND2 = bm25_sql([_both("anea"), _both("onat")], "p0 > 0 AND p1 > 0")
OR3 = bm25_sql([_both("anea"), _both("onat"), _both("pour")], "p0 > 0 OR p1 > 0 OR p2 > 0", 50)
lexical("bm25_single", "anea", bm25_sql([_both("anea")], "p0 > 0"))
lexical("bm25_multi_and", "anea onat", AND2)
lexical("bm25_or", "anea OR onat OR pour", OR3, 50)
lexical("bm25_heading_weight", "src5 OR reou", bm25_sql([_both("src5"), _both("reou")], "p0 > 0 OR p1 > 0", 100), 100)
lexical("bm25_prefix_scope", "anea OR onat", bm25_sql([_both("anea"), _both("onat")], "p0 > 0 OR p1 > 0", 10, "starts_with(file_path, '/corpus/src1/')"), prefix="/corpus/src1")
lexical("match_phrase", '"and attion"', bm25_sql([_both("and", "attion")], "p0 > 0", 30), 30)
lexical("match_phrase_plus", "attion + to", bm25_sql([_both("attion", "to")], "p0 > 0", 30), 30)
lexical("match_prefix", "thonea*", bm25_sql([("len(list_filter(ct, lambda x: starts_with(x, 'thonea')))", "len(list_filter(ht, lambda x: starts_with(x, 'thonea')))")], "p0 > 0", 30), 30)
lexical("match_boolean", "anea AND onat NOT reou OR pour", bm25_sql([_both("anea"), _both("onat"), _both("pour"), _both("reou")], "(p0 > 0 AND (p1 > 0 AND NOT p3 > 0)) OR p2 > 0", 30, "true", 3), 30)
lexical("match_grouped", "(anea OR onat) AND (reou OR anon)", bm25_sql([_both("anea"), _both("onat"), _both("reou"), _both("anon")], "(p0 > 0 OR p1 > 0) AND (p2 > 0 OR p3 > 0)", 30), 30)
_NEAR = "len(list_filter(range(1, len({0}) + 1), lambda i: {0}[i] = '{1}' AND len(list_filter(range(i, least(i + 5, len({0}) + 1)), lambda j: {0}[j] = '{2}')) > 0))"
_near = lambda c: f"{_NEAR.format(c, 'anea', 'that')} + {_NEAR.format(c, 'that', 'anea')}"
lexical("match_near", "NEAR(anea that, 3)", bm25_sql([(_near("ct"), _near("ht"))], "p0 > 0", 30), 30)
lexical("match_column", "heading : src7 AND content : anea", bm25_sql([("0", _phrase("ht", "src7")), (_phrase("ct", "anea"), "0")], "p0 > 0 AND p1 > 0", 30), 30)
lexical("match_columns", "{heading content} : fr", bm25_sql([_both("fr")], "p0 > 0", 30), 30)
lexical("match_initial", "content : ^the", bm25_sql([("(ct[1] = 'the')::INT", "0")], "p0 > 0", 30), 30)
lexical("match_unindexed_column", "file_path : corpus", NONE)
lexical("ladder_and_hit", "anea onat?", AND2, ladder=True)
lexical("ladder_or_fallback", "anea zzqx", bm25_sql([_both("anea"), _both("zzqx")], "p0 > 0 OR p1 > 0"), ladder=True)
lexical("ladder_strict", "anea zzqx", NONE, ladder=True, strict=True)
lexical("ladder_syntax_repair", "what? anea (onat", bm25_sql([_both("what"), _both("anea"), _both("onat")], "p0 > 0 AND p1 > 0 AND p2 > 0"), ladder=True)
lexical("ladder_operator_stop", "anea AND zzqx", NONE, ladder=True)
lexical("ladder_operator_syntax", "anea AND (", NONE, ladder=True)
lexical("ladder_exclusion", "anea -onat", bm25_sql([_both("anea")], "p0 > 0"), ladder=True)
lexical("limit_below_one", "anea", NONE, 0, ladder=True)


@query("bm25_index_lookup", OR3)
def _(spark, sf):
    return _ranked(D.indexed(spark, sf).best("anea OR onat OR pour", 50))


@query("stored_index_stats", f"WITH {D.TOKENISED} SELECT count(*) AS n, sum(len(ct) + len(ht))::BIGINT AS words, (SELECT count(*) FROM documents) AS chunks FROM t")
def _(spark, sf):
    """Builds the index if this session has none yet."""
    index = D.indexed(spark, sf)
    return index.stats.crossJoin(F.broadcast(index.chunks.agg(F.count("*").alias("chunks"))))  # one row each


@query("bm25_scan", OR3)
def _(spark, sf):
    """Without an index: one pass over the tokens of all chunks."""
    return _ranked(R.run_query(D.searchable(spark, sf), "anea OR onat OR pour", 50))


@query(
    "lexical_hits",
    f"WITH hits AS ({AND2}), {D.FILES} SELECT file_path AS path, lang || ' ' || source AS heading, score, 'fts' AS method, chunk_id, CASE WHEN mtime_ns >= 0 THEN strftime(make_timestamp(mtime_ns // 1000000000 * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END AS mtime, {_clip_sql('text', 60)} AS snippet "
    "FROM hits JOIN documents ON doc_id = chunk_id JOIN files ON path = file_path",
)
def _(spark, sf):
    return R.search_hits(D.indexed(spark, sf).search("anea onat"), D.files(spark, sf), "anea onat", 60)


@query("fts_snippet")
def _(spark, sf):
    return R.search_hits(D.indexed(spark, sf).search("anea onat"), D.files(spark, sf), "anea onat").select("chunk_id", "snippet")


# --- Vectors -----------------------------------------------------------------------------------------------------

Q0 = "q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7)"
COS = "CASE WHEN sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) = 0 THEN 0.0 ELSE list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) END"


def _vector(spark, sf, k=7):
    return list(D.vectors(spark, sf).where(F.col("chunk_id") == k).first()["vector"])


def _vector_ranks(rows):
    w = Window.orderBy(F.desc("score"), "chunk_id")
    return rows.select(F.row_number().over(w).cast("long").alias("rank"), "chunk_id", F.round("score", 4).alias("score"))


def _topk_sql(where: str = "true", limit: int = 10) -> str:
    return f"WITH {Q0}, s AS (SELECT vec_id AS chunk_id, {COS} AS score FROM embeddings, q WHERE {where}) SELECT row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, chunk_id, round(score, 4) AS score FROM s ORDER BY score DESC, chunk_id LIMIT {limit}"


@query("cosine_topk", _topk_sql())
def _(spark, sf):
    return _vector_ranks(V.top_k(D.vectors(spark, sf), _vector(spark, sf), 10))


@query("cosine_topk_vectorised", _topk_sql())
def _(spark, sf):
    return _vector_ranks(V.top_k_batch(D.vectors(spark, sf), _vector(spark, sf), 10))


@query("cosine_topk_stored", _topk_sql())
def _(spark, sf):
    """Over the unit vectors that the store keeps beside the vectors."""
    return _vector_ranks(V.top_k_units(D.stored_vectors(spark, sf).table("units"), _vector(spark, sf), 10))


@query("stored_units_audit", "SELECT vec_id AS chunk_id, NULL::VARCHAR AS fault FROM embeddings WHERE false")
def _(spark, sf):
    """Stored unit vectors that do not fit their vectors; there are none."""
    return V.audit(D.vectors(spark, sf), D.stored_vectors(spark, sf).table("units"))


@query("cosine_scoped", _topk_sql("vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1')"))
def _(spark, sf):
    allowed = D.chunks(spark, sf).where(C.under(F.col("file_path"), "/corpus/src1")).select("chunk_id")
    return _vector_ranks(V.top_k(D.vectors(spark, sf), _vector(spark, sf), 10, allowed))


@query("cosine_dim_filter", _topk_sql("vec_id % 3 <> 0"))
def _(spark, sf):
    v = D.vectors(spark, sf).withColumn("vector", F.when(F.col("chunk_id") % 3 == 0, F.slice("vector", 1, 4)).otherwise(F.col("vector")))
    return _vector_ranks(V.top_k(v, _vector(spark, sf), 10))


@query("normalised_matrix", "SELECT vec_id AS chunk_id, len(embedding)::INT AS dim, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS first FROM embeddings")
def _(spark, sf):
    n = V.normalised(D.vectors(spark, sf))
    return n.select("chunk_id", "dim", F.round("norm", 4).alias("norm"), F.round(F.element_at("unit", 1), 4).alias("first"))


@query("vector_audit", "SELECT vec_id AS chunk_id, CASE WHEN vec_id % 10 = 0 THEN 'missing' ELSE 'changed' END AS fault FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 10 = 1 UNION ALL SELECT -1, 'surplus'")
def _(spark, sf):
    v = D.vectors(spark, sf)
    cache = V.normalised(v).where("chunk_id % 10 <> 0").select("chunk_id", F.when(F.col("chunk_id") % 10 == 1, F.transform("unit", lambda x: -x)).otherwise(F.col("unit")).alias("unit"))
    return V.audit(v, cache.unionByName(spark.createDataFrame([(-1, [1.0])], "chunk_id long, unit array<double>")))


@query("zero_norm_guard", "SELECT vec_id AS chunk_id, 0.0::DOUBLE AS score FROM embeddings")
def _(spark, sf):
    v = D.vectors(spark, sf)
    zero = F.transform("vector", lambda x: x * 0)
    found = V.top_k(v, [0.0] * 64, 10).select("chunk_id", "score")
    return v.select("chunk_id", V.cosine(zero, F.col("vector")).alias("score")).unionByName(found)


@query("vector_fingerprint", "SELECT count(*) AS n, max(vec_id) AS last, count(*) || ':' || max(vec_id) AS rev FROM embeddings")
def _(spark, sf):
    return V.fingerprint(D.vectors(spark, sf))


@query("vector_bytes", "SELECT vec_id AS chunk_id, len(embedding) * 4 AS n, true AS same FROM embeddings")
def _(spark, sf):
    v = D.vectors(spark, sf).withColumn("b", V.pack_vector(F.col("vector")))
    return v.select("chunk_id", F.length("b").cast("long").alias("n"), (V.unpack_vector(F.col("b")) == F.col("vector")).alias("same"))


@query(
    "hash_embed",
    f"WITH {D.CHUNKS}, x AS (SELECT chunk_id, sha256(content) AS h FROM chunks) SELECT chunk_id, array_to_string(list_transform(range(8), lambda i: round(('0x' || h[i * 2 + 1 : i * 2 + 2])::INT / 255.0::DOUBLE, 4)::VARCHAR), ',') AS vector FROM x",
)
def _(spark, sf):
    e = embedders.hash_embedding(F.col("content"), 8)
    return D.chunks(spark, sf).select("chunk_id", F.array_join(F.transform(e, lambda x: F.round(x, 4).cast("string")), ",").alias("vector"))


# --- Fusion ------------------------------------------------------------------------------------------------------

LISTS = f"""lex AS ({bm25_sql([_both('anea'), _both('onat'), _both('pour')], 'p0 > 0 OR p1 > 0 OR p2 > 0', 40)}),
sem AS ({_topk_sql('true', 40)}),
u AS (SELECT chunk_id, rank, 0 AS o, 'fts' AS m FROM lex UNION ALL SELECT chunk_id, rank, 1, 'semantic' FROM sem),
f AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 4) AS score, min(o) AS o, arg_min(rank, o) AS r, string_agg(m, ',' ORDER BY o) AS methods FROM u GROUP BY chunk_id)"""
FUSED = f"WITH {LISTS} SELECT row_number() OVER (ORDER BY score DESC, o, r) AS rank, chunk_id, score, methods FROM f ORDER BY score DESC, o, r LIMIT 20"


def _two_lists(spark, sf, n=40):
    index = D.indexed(spark, sf)
    found = index.best("anea OR onat OR pour", n)
    lex = found.select("chunk_id", F.col("file_path").alias("path"), F.coalesce("heading", F.lit("")).alias("heading"), X.clip_words(F.col("content"), 40).alias("snippet"), "score", F.lit("fts").alias("method"))
    rows = index.looked_up(V.top_k(D.vectors(spark, sf), _vector(spark, sf), n), "left")
    sem = rows.select("chunk_id", F.col("file_path").alias("path"), F.coalesce("heading", F.lit("")).alias("heading"), X.semantic_snippet(F.col("content")).alias("snippet"), "score", F.lit("semantic").alias("method"))
    return lex.select(sem.columns), sem


@query("rrf_fuse", FUSED)
def _(spark, sf):
    top = H.fuse(list(_two_lists(spark, sf)), 20).withColumn("at", F.monotonically_increasing_id())
    w = Window.orderBy("at")
    return top.select(F.row_number().over(w).cast("long").alias("rank"), "chunk_id", "score", F.array_join("methods", ",").alias("methods"))


@query("hybrid_search", f"WITH {LISTS}, b AS (SELECT * FROM f ORDER BY score DESC, o, r LIMIT 10) SELECT b.chunk_id, score, 'combined' AS method, '/corpus/' || source || '/' || lang || '/' || doc_id || '.txt' AS path FROM b LEFT JOIN documents ON doc_id = b.chunk_id")
def _(spark, sf):
    lex, sem = _two_lists(spark, sf)
    return H.hybrid(lex, sem, 10)[0].select("chunk_id", "score", "method", "path")


@query("hybrid_methods", f"WITH {LISTS} SELECT methods, count(*) AS n FROM f GROUP BY methods")
def _(spark, sf):
    return H.fuse(list(_two_lists(spark, sf)), 1000).groupBy(F.array_join("methods", ",").alias("methods")).agg(F.count("*").alias("n"))


@query("hybrid_degraded", f"WITH lex AS ({AND2}) SELECT chunk_id, score, true AS degraded FROM lex")
def _(spark, sf):
    lex = R.shaped(D.indexed(spark, sf).best("anea onat", 10), "fts", F.lit(""))
    hits, degraded = H.hybrid(lex, None)
    return hits.select("chunk_id", "score", F.lit(degraded).alias("degraded"))


@query("semantic_hits", f"WITH s AS ({_topk_sql()}) SELECT chunk_id, score, 'semantic' AS method, lang || ' ' || source AS heading, {_clip_sql('t', 200)} AS snippet FROM (SELECT s.*, lang, source, replace(text, chr(10), ' ') AS t FROM s JOIN documents ON doc_id = chunk_id)")
def _(spark, sf):
    near = V.top_k(D.vectors(spark, sf), _vector(spark, sf), 10).join(D.chunks(spark, sf), "chunk_id")
    return R.shaped(near, "semantic", X.semantic_snippet(F.col("content"))).select("chunk_id", "score", "method", "heading", "snippet")


# --- Status ------------------------------------------------------------------------------------------------------


@query("status_counts", "SELECT (SELECT count(*) FROM documents) AS files, (SELECT count(*) FROM documents) AS chunks, (SELECT count(*) FROM embeddings) AS embeddings")
def _(spark, sf):
    return S.totals(D.files(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf))


@query("status_per_root", f"WITH {D.FILES}, r AS (SELECT '/corpus/src' || i AS directory FROM range(25) x(i)) SELECT r.directory, count(path) AS files FROM r LEFT JOIN files f ON f.directory = r.directory GROUP BY r.directory")
def _(spark, sf):
    roots = spark.range(25).select(F.concat(F.lit(f"{D.ROOT}/src"), F.col("id").cast("string")).alias("directory"))
    return S.per_root(roots, D.files(spark, sf))


@query("embedding_coverage", f"WITH {D.FILES} SELECT path, 1 AS chunks, count(vec_id) AS embedded FROM files LEFT JOIN embeddings ON vec_id = doc_id GROUP BY path")
def _(spark, sf):
    return S.coverage(D.files(spark, sf), D.chunks(spark, sf), D.vectors(spark, sf))


@query("missing_embeddings", f"WITH {D.CHUNKS} SELECT chunk_id FROM chunks WHERE length({STRIP.format('content')}) >= 50 AND chunk_id NOT IN (SELECT vec_id FROM embeddings)")
def _(spark, sf):
    return S.missing_embeddings(D.chunks(spark, sf), D.vectors(spark, sf), X.MIN_EMBED).select("chunk_id")


@query("meta_map", f"WITH {D.META}, l AS (SELECT key, arg_max(value, written) AS value FROM meta GROUP BY key) SELECT string_agg(key || '=' || value, ';' ORDER BY key) AS meta FROM l")
def _(spark, sf):
    m = S.meta_map(C.upserted(D.meta(spark), "key", "written"))
    return m.select(F.array_join(F.transform(F.map_entries("meta"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("meta"))


@query("hits_as_json", f"WITH lex AS ({AND2}) SELECT '{{\"chunk_id\":' || chunk_id || ',\"path\":\"' || file_path || '\"}}' AS line FROM lex")
def _(spark, sf):
    rows = D.indexed(spark, sf).best("anea onat", 10)
    return rows.select(F.to_json(F.struct("chunk_id", F.col("file_path").alias("path"))).alias("line"))


@query("hits_as_text", f"WITH lex AS ({AND2}) SELECT printf('[%.2f] %s', score, file_path) AS line FROM lex")
def _(spark, sf):
    rows = D.indexed(spark, sf).best("anea onat", 10)
    return rows.select(F.format_string("[%.2f] %s", F.round("score", 4), "file_path").alias("line"))


# --- Seams and streams -------------------------------------------------------------------------------------------


@query("extract_udf_routing", "SELECT CASE doc_id % 5 WHEN 3 THEN 'unavailable' WHEN 4 THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    return readers.routing_demo(D.files(spark, sf), D.table(spark, sf, "documents")).groupBy("status").agg(F.count("*").alias("n"))


@query("embed_udf_outcomes", "SELECT CASE WHEN doc_id % 11 = 0 THEN 'permanent' WHEN doc_id % 13 = 0 THEN 'transient' ELSE 'ok' END AS status, count(*) AS n FROM documents GROUP BY 1")
def _(spark, sf):
    rows = D.chunks(spark, sf).select("chunk_id", F.concat(F.when(F.col("chunk_id") % 11 == 0, "POISON ").when(F.col("chunk_id") % 13 == 0, "DOWN ").otherwise(""), "content").alias("text"))
    return embedders.embedded(rows, embedders.faulty_hash_embedder(8)).groupBy("status").agg(F.count("*").alias("n"))


@query("incremental_foreach_batch", f"WITH {D.TOKENISED} SELECT count(*) AS chunks, sum(len(ct))::BIGINT AS tokens FROM t")
def _(spark, sf):
    return incremental.indexed_by_stream(spark, f"{sf}/documents.parquet")
