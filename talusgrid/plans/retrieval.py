"""Lexical and vector retrieval, fusion and the composed hybrid pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import FUSION, depth
from ..functions.text import query_terms, search_tokens
from ..operators import automaton, blockmax, cells, fusion, lexical, segments, vector
from ..scratch import scratch_path, settle
from .base import Suite, Tables, tokens_sql

suite = Suite()
query = suite.query

#: The question of the single-query plans and the table of its synonyms.
QUESTION = "the nation that was of heed and ing"
SYNONYMS = {"nation": ["tion", "ation"], "heed": ["hede"], "ing": ["inging"]}
BOILERPLATE = (r"(?i)all rights reserved", r"(?i)licen[sc]ed? under", r"(?i)\bversion \d", r"(?i)released under the")


def _values(terms: list[str]) -> str:
    return ", ".join(f"('{t}')" for t in terms)


def bm25_sql(terms: str, k: int, p: str = "l", docs: str = "documents") -> str:
    """``terms`` is SQL of rows (query_id, term); the result's name is ``p`` and an x."""
    return f"""
{p}d AS (SELECT doc_id AS id, {tokens_sql("text")} AS t FROM {docs}),
{p}st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {p}d),
{p}q AS (SELECT DISTINCT query_id, term FROM ({terms})),
{p}tf AS (SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(t) AS dl, unnest(t) AS term FROM {p}d) WHERE term IN (SELECT term FROM {p}q) GROUP BY ALL),
{p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY term),
{p}sc AS (SELECT query_id, id, round(sum(ln((n - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score
       FROM {p}tf JOIN {p}df USING (term) JOIN {p}q USING (term), {p}st GROUP BY query_id, id),
{p}x AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}sc QUALIFY rank <= {k})"""


def knn_sql(queries: str, k: int, where: str = "true", p: str = "v", part: str = "embedding") -> str:
    """``queries`` is SQL of rows (query_id, v); the result's name is ``p`` and an x."""
    dot = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
    return f"""
{p}e AS (SELECT vec_id AS id, label, {part}::DOUBLE[] AS v FROM embeddings WHERE {where}),
{p}q AS ({queries}),
{p}s AS (SELECT query_id, e.id, e.label, round({dot("q.v", "e.v")} / (sqrt({dot("q.v", "q.v")}) * sqrt({dot("e.v", "e.v")})), 6) + 0 AS score FROM {p}e e, {p}q q),
{p}x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}s QUALIFY rank <= {k})"""


ONE_QUERY = f"SELECT 0 AS query_id, unnest({tokens_sql(chr(39) + QUESTION + chr(39))}) AS term"
ONE_VECTOR = "SELECT 0 AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0"


@query(f"WITH {bm25_sql(ONE_QUERY, 10)} SELECT id AS doc_id, score, rank FROM lx")
def bm25_topk(t: Tables) -> DataFrame:
    found = lexical.search_one(t.documents, QUESTION, 10, "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {bm25_sql(ONE_QUERY, 10)} SELECT id AS doc_id, score, rank FROM lx")
def bm25_index_topk(t: Tables) -> DataFrame:
    """The question over an index that is written once and read back by its words."""
    path = scratch_path(t.spark, "lexical-index")
    lexical.build_index(t.documents, "doc_id", "text").write(path)
    questions = t.rows("query_id int, query string", [(0, QUESTION)])
    return lexical.search_index(lexical.Index.read(t.spark, path), questions, 10).select(F.col("id").alias("doc_id"), "score", "rank")


#: The documents after two rounds of changes: some added late, some given another's words, some deleted, some of those back.
_CHANGED_SQL = """now AS (SELECT doc_id, text FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 7 <> 0 UNION ALL SELECT doc_id, source || ' the nation and heed of ' || text FROM documents WHERE doc_id % 7 = 0 AND doc_id % 11 <> 0
UNION ALL SELECT doc_id, 'back with ing and heed' FROM documents WHERE doc_id % 22 = 0)"""


def _changed_index(t: Tables) -> segments.SegmentedIndex:
    docs = t.documents.select("doc_id", "text", "source")
    index = segments.SegmentedIndex.create(docs.where("doc_id % 5 <> 0"), "doc_id", "text", scratch_path(t.spark, "segments"))
    worded = docs.where("doc_id % 7 = 0").withColumn("text", F.concat("source", F.lit(" the nation and heed of "), "text"))
    index.apply(docs.where("doc_id % 5 = 0 AND doc_id % 7 <> 0").unionByName(worded), docs.where("doc_id % 11 = 0 AND doc_id % 7 <> 0 AND doc_id % 5 <> 0"), "doc_id", "text")
    index.apply(docs.where("doc_id % 22 = 0").withColumn("text", F.lit("back with ing and heed")), docs.where("doc_id % 11 = 0"), "doc_id", "text")
    return index


def _ask(t: Tables, index: lexical.Index, k: int) -> DataFrame:
    found = lexical.search_index(index, t.rows("query_id int, query string", [(0, QUESTION)]), k)
    return found.select(F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {_CHANGED_SQL}, {bm25_sql(ONE_QUERY, 40, docs='now')} SELECT id AS doc_id, score, rank FROM lx")
def bm25_segments_topk(t: Tables) -> DataFrame:
    """Over an index that was changed twice and never rebuilt."""
    return _ask(t, _changed_index(t).index(), 40)


@query(f"WITH {_CHANGED_SQL}, {bm25_sql(ONE_QUERY, 40, docs='now')} SELECT id AS doc_id, score, rank FROM lx")
def bm25_compacted_topk(t: Tables) -> DataFrame:
    """Over the same changes after compaction."""
    index = _changed_index(t)
    index.compact()
    return _ask(t, index.index(), 40)


@query(f"""WITH {_CHANGED_SQL}, d AS (SELECT doc_id, {tokens_sql("text")} AS t FROM now), p AS (SELECT DISTINCT doc_id, unnest(t) AS term FROM d)
SELECT term, count(*) AS df, (SELECT count(*) FROM d) AS n_docs, round((SELECT avg(len(t)) FROM d), 6) AS avgdl FROM p GROUP BY term""")
def segment_statistics(t: Tables) -> DataFrame:
    """All document frequencies and corpus numbers as the segments' sums give them."""
    index = _changed_index(t).index()
    return index.terms.crossJoin(F.broadcast(index.stats)).select("term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))  # one row


@query(f"WITH {bm25_sql('SELECT item_id AS query_id, unnest(' + tokens_sql('text') + ') AS term FROM benchmark', 5)} SELECT query_id AS item_id, id AS doc_id, score, rank FROM lx")
def bm25_topk_batch(t: Tables) -> DataFrame:
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found = lexical.search(t.documents, queries, 5, "doc_id", "text")
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


def _blocks(t: Tables, shard_docs: int) -> blockmax.BlockIndex:
    path = scratch_path(t.spark, "blocks")
    index = lexical.build_index(t.documents, "doc_id", "text")
    blockmax.build(index, shard_docs).write(path)
    return blockmax.BlockIndex.read(t.spark, path)


@query(f"WITH {bm25_sql('SELECT item_id AS query_id, unnest(' + tokens_sql('text') + ') AS term FROM benchmark', 5)} SELECT query_id AS item_id, id AS doc_id, score, rank FROM lx")
def bm25_blocks_topk(t: Tables) -> DataFrame:
    """The items over postings in blocks; ranges whose bound is below the fifth score stay unread."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    found, _ = blockmax.search(_blocks(t, 50_000), queries, 5)
    return found.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query()
def block_pruning(t: Tables) -> DataFrame:
    """Of each item's blocks, how many a search for the best document had to read."""
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    _, read = blockmax.search(_blocks(t, 50_000), queries, 1)
    return read.select(F.col("query_id").alias("item_id"), "blocks", "needed", (F.col("blocks") - F.col("needed")).alias("skipped"))


_EXPANDED = " UNION ALL ".join([ONE_QUERY] + [f"SELECT 0, '{s}'" for k, v in SYNONYMS.items() if k in QUESTION.split() for s in v])


@query(f"WITH {bm25_sql(_EXPANDED, 10)} SELECT id AS doc_id, score, rank FROM lx")
def bm25_synonyms(t: Tables) -> DataFrame:
    found = lexical.search_one(t.documents, QUESTION, 10, "doc_id", "text", synonyms=SYNONYMS)
    return found.select(F.col("id").alias("doc_id"), "score", "rank")


@query(f"""WITH d AS (SELECT doc_id, {tokens_sql("text")} AS t FROM documents)
SELECT count(*) AS n_docs, round(avg(len(t)), 6) AS avgdl, sum(len(t))::BIGINT AS n_tokens, (SELECT count(DISTINCT u) FROM (SELECT unnest(t) AS u FROM d)) AS n_terms FROM d""")
def bm25_index_stats(t: Tables) -> DataFrame:
    tokens = t.documents.select(search_tokens(F.col("text")).alias("t"))
    sizes = tokens.agg(F.count("*").alias("n_docs"), F.round(F.avg(F.size("t")), 6).alias("avgdl"), F.sum(F.size("t")).cast("long").alias("n_tokens"))
    terms = tokens.select(F.explode("t").alias("u")).distinct().agg(F.count("*").alias("n_terms"))
    return sizes.crossJoin(F.broadcast(terms))  # one row each


@query(f"""WITH p AS (SELECT DISTINCT doc_id, unnest({tokens_sql("text")}) AS term FROM documents)
SELECT term, count(*) AS df FROM p GROUP BY term ORDER BY df DESC, term LIMIT 50""")
def term_df_top(t: Tables) -> DataFrame:
    terms = lexical.build_index(t.documents, "doc_id", "text").terms
    return terms.orderBy(F.desc("df"), "term").limit(50)


@query(r"""WITH f AS (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]+(?: [A-Z][a-z]+){0,3}')) AS term FROM documents),
s AS (SELECT term, count(*) AS k, regexp_replace(lower(term), '[^a-z0-9]', '', 'g') AS key FROM f WHERE lower(string_split(term, ' ')[1]) NOT IN ('the', 'and', 'of') GROUP BY term),
m AS (SELECT max(struct_pack(k := k, term := term)) AS best, sum(k)::BIGINT AS n FROM s GROUP BY key)
SELECT best.term AS term, n FROM m WHERE n >= 2 AND (contains(best.term, ' ') OR n >= 10)""")
def lexicon_phrases(t: Tables) -> DataFrame:
    return lexical.lexicon(t.documents, "text", ("the", "and", "of"))


@query(f"WITH {knn_sql(ONE_VECTOR, 10)} SELECT id AS vec_id, score, rank FROM vx")
def knn_cosine(t: Tables) -> DataFrame:
    return _nearest(t, t.embeddings, 10).select(F.col("id").alias("vec_id"), "score", "rank")


def _nearest(t: Tables, rows: DataFrame, k: int) -> DataFrame:
    one = t.embeddings.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"))
    return vector.neighbours(rows, one, k)


@query(f"WITH {knn_sql(ONE_VECTOR, 10, 'label IN (1, 3, 5)')} SELECT id AS vec_id, score, rank FROM vx")
def knn_cosine_filtered(t: Tables) -> DataFrame:
    targets = t.rows("label int", [(1,), (3,), (5,)])
    return _nearest(t, t.embeddings.join(targets, "label", "left_semi"), 10).select(F.col("id").alias("vec_id"), "score", "rank")


@query(f"WITH {knn_sql('SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0', 5)} SELECT query_id, id AS vec_id, score, rank FROM vx")
def knn_batch(t: Tables) -> DataFrame:
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return vector.neighbours(t.embeddings, queries, 5).select("query_id", F.col("id").alias("vec_id"), "score", "rank")


def _celled(t: Tables) -> tuple[cells.Cells, DataFrame]:
    queries = t.embeddings.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return cells.build(t.embeddings, scratch_path(t.spark, "cells"), 32), queries


@query(f"WITH {knn_sql('SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0', 5)} SELECT query_id, id AS vec_id, score, rank FROM vx")
def knn_cells(t: Tables) -> DataFrame:
    """The batch through cells whose bounds make it exact."""
    found, _ = cells.search(*_celled(t), 5)
    return found.select("query_id", F.col("id").alias("vec_id"), "score", "rank")


@query()
def knn_cell_recall(t: Tables) -> DataFrame:
    """Of each query's five nearest vectors the share that its two nearest cells hold, and the cells that the exact search needs."""
    index, queries = _celled(t)
    exact, probed = cells.search(index, queries, 5)
    near, _ = cells.search(index, queries, 5, probes=2, exact=False)
    hit = exact.select("query_id", "id").join(near.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall")).join(probed, "query_id")


@query(f"""WITH {knn_sql(ONE_VECTOR, 50)}
SELECT id AS vec_id, round((score - min(score) OVER ()) / coalesce(nullif(max(score) OVER () - min(score) OVER (), 0), 1), 6) AS score FROM vx""")
def minmax_scores(t: Tables) -> DataFrame:
    found = vector.min_max(_nearest(t, t.embeddings, 50))
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def topics(t: Tables) -> DataFrame:
    """Topic vectors: shorter ones, several of which belong to a parent row: topic_id, parent_id, vector."""
    parent = F.col("vec_id") - F.col("vec_id") % 4
    return t.embeddings.select(F.col("vec_id").alias("topic_id"), parent.alias("parent_id"), F.slice("embedding", 1, 32).alias("vector"))


def _near_topics(t: Tables, k: int, query_id: int = 0) -> DataFrame:
    """The parents of the nearest topics with each topic's score: query_id, id, score."""
    table = topics(t)
    one = table.where(F.col("topic_id") == query_id).select(F.lit(0).alias("query_id"), "vector")
    found = vector.min_max(vector.neighbours(table, one, k, "topic_id", "vector"))
    return found.join(table.select(F.col("topic_id").alias("id"), "parent_id"), "id").select("query_id", F.col("parent_id").alias("id"), "score")


ONE_TOPIC = "SELECT 0 AS query_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0"
_MINMAX = "(score - min(score) OVER ()) / coalesce(nullif(max(score) OVER () - min(score) OVER (), 0), 1)"
_MERGED_SQL = f"""{knn_sql(ONE_VECTOR, 60)}, {knn_sql(ONE_TOPIC, 60, p='w', part='embedding[1:32]')},
vn AS (SELECT id, {_MINMAX} AS score FROM vx), wn AS (SELECT id, {_MINMAX} AS score FROM wx),
tp AS (SELECT id - id % 4 AS id, max(score) * 0.85e0 AS topic FROM wn GROUP BY 1),
mg AS (SELECT coalesce(vn.id, tp.id) AS id, round(greatest(score, topic), 6) AS score,
       CASE WHEN topic IS NULL THEN 'fulltext' WHEN score IS NULL THEN 'topic' ELSE 'both' END AS matched_via FROM vn FULL JOIN tp ON vn.id = tp.id)"""


def _merged(t: Tables, near: DataFrame, k: int, query_id: int = 0) -> DataFrame:
    merged = vector.merge_topics(vector.min_max(near).select("id", "score"), _near_topics(t, k, query_id), FUSION.topic_discount)
    return merged.withColumn("score", F.round("score", 6))


@query(f"WITH {knn_sql(ONE_TOPIC, 10, part='embedding[1:32]')} SELECT id AS topic_id, id - id % 4 AS parent_id, score, rank FROM vx")
def topic_knn(t: Tables) -> DataFrame:
    table = topics(t)
    one = table.where("topic_id = 0").select(F.lit(0).alias("query_id"), "vector")
    return vector.neighbours(table, one, 10, "topic_id", "vector").join(table.select(F.col("topic_id").alias("id"), "parent_id"), "id").select(F.col("id").alias("topic_id"), "parent_id", "score", "rank")


@query(f"WITH {_MERGED_SQL} SELECT id, score, matched_via FROM mg")
def topic_parent_merge(t: Tables) -> DataFrame:
    return _merged(t, _nearest(t, t.embeddings, 60), 60)


@query(f"WITH {knn_sql(ONE_VECTOR, 15)} SELECT id AS vec_id, score, rank FROM vx WHERE rank <= 12")
def embedding_only(t: Tables) -> DataFrame:
    k = depth("interpretive", 0.9)
    one = t.embeddings.where("vec_id = 0").select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector"))
    return vector.nearest_only(t.embeddings, one, k.vector, k.final).select(F.col("id").alias("vec_id"), "score", "rank")


FUSED_SQL = """
fu AS (SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.id, l.id) AS id,
              round(coalesce(1 / (60 + v.rank), 0e0) + coalesce(1 / (60 + l.rank), 0e0), 6) AS score,
              CASE WHEN l.id IS NULL THEN 'embedding' WHEN v.id IS NULL THEN 'bm25' ELSE 'both' END AS source, coalesce(v.rank, 1000000 + l.rank) AS ord
       FROM vx v FULL JOIN lx l ON v.id = l.id AND v.query_id = l.query_id)"""


def _lists(t: Tables, k: int = 40) -> tuple[DataFrame, DataFrame]:
    """The vector and lexical lists of the question; rows of documents and embeddings with one id are one."""
    lex = lexical.search_one(t.documents, QUESTION, k, "doc_id", "text").withColumn("query_id", F.lit(0))
    return _nearest(t, t.embeddings, k), lex


_FUSED = f"{bm25_sql(ONE_QUERY, 40)}, {knn_sql(ONE_VECTOR, 40)}, {FUSED_SQL}"


@query(f"WITH {_FUSED} SELECT id, score, source FROM fu")
def rrf_fusion(t: Tables) -> DataFrame:
    return fusion.fuse_ranks(*_lists(t)).select("id", "score", "source")


#: Supplemental questions with the ids of their vectors; the SQL of the first one's words (with synonyms) and vector.
SUPPLEMENTAL = (("the shares of heed by fr", 1),)
_ALSO_SQL = f"SELECT 1 AS query_id, unnest({tokens_sql(chr(39) + SUPPLEMENTAL[0][0] + chr(39))}) AS term UNION ALL SELECT 1, 'hede'"
_ALSO_VECTOR = "SELECT 1 AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1"


def _vectors_near(t: Tables, supplemental: tuple[tuple[str, int], ...], k: int) -> DataFrame:
    """The vector lists of supplemental questions, numbered from 1."""
    asked = t.rows("query_id int, vec_id long", [(n, i) for n, (_, i) in enumerate(supplemental, 1)])
    vectors = t.embeddings.join(F.broadcast(asked), "vec_id").select("query_id", F.col("embedding").alias("vector"))  # a row a question
    return vector.neighbours(t.embeddings, vectors, k)


@query(f"""WITH {_FUSED}, {bm25_sql(_ALSO_SQL, 20, p='m')}, {knn_sql(_ALSO_VECTOR, 20, p='s')},
sp AS (SELECT coalesce(v.id, l.id) AS id, 0.7e0 * round(coalesce(1 / (60 + v.rank), 0e0) + coalesce(1 / (60 + l.rank), 0e0), 6) AS more FROM sx v FULL JOIN mx l ON v.id = l.id)
SELECT coalesce(fu.id, sp.id) AS id, round(coalesce(score, 0) + coalesce(more, 0), 6) AS score, coalesce(source, 'bm25') AS source FROM fu FULL JOIN sp ON fu.id = sp.id""")
def rrf_supplemental(t: Tables) -> DataFrame:
    """The fused list, and what a supplemental question's own fused list adds to it."""
    near, lex = _lists(t)
    words = lexical.search(t.documents, t.rows("query_id int, query string", [(1, SUPPLEMENTAL[0][0])]), 20, "doc_id", "text", synonyms=SYNONYMS)
    extra = fusion.fuse_ranks(_vectors_near(t, SUPPLEMENTAL, 20), words).withColumn("query_id", F.lit(0))
    return fusion.add_supplemental(fusion.fuse_ranks(near, lex), extra).select("id", "score", "source")


TERMS = ("nation", "heed", "ing")
_TERMS_SQL = "['nation', 'heed', 'ing']"
_HITS_SQL = f"len(list_filter({_TERMS_SQL}, lambda w: contains(lower(text), w)))"


@query(f"SELECT doc_id, {_HITS_SQL}::INT AS hits, round(1 + {_HITS_SQL} * 0.15e0, 6) AS factor FROM documents")
def keyword_boost(t: Tables) -> DataFrame:
    terms = F.array(*map(F.lit, TERMS))
    return t.documents.select("doc_id", fusion.keyword_hits(F.col("text"), terms).alias("hits"), F.round(fusion.keyword_factor(F.col("text"), terms), 6).alias("factor"))


@query("SELECT doc_id, CASE WHEN source IN ('src1', 'src2') THEN 1.5e0 ELSE 1e0 END AS factor FROM documents")
def episode_boost(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fusion.group_factor(F.col("source"), ["src1", "src2"]).alias("factor"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(role), 'assist') THEN 1.3e0 ELSE 1e0 END AS factor FROM conversations")
def speaker_boost(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", fusion.member_factor(F.col("role"), ["Assist"], FUSION.speaker_boost).alias("factor"))


_BOILER_SQL = " + ".join(f"regexp_matches(text, '{p}')::INT" for p in BOILERPLATE)


@query(f"SELECT doc_id, CASE WHEN {_BOILER_SQL} >= 2 THEN 0.3e0 WHEN {_BOILER_SQL} = 1 THEN 0.6e0 ELSE 1e0 END AS factor FROM documents")
def boilerplate_penalty(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", fusion.boilerplate_factor(F.col("text"), BOILERPLATE).alias("factor"))


@query(f"""WITH {bm25_sql(ONE_QUERY, 10)}, {knn_sql(ONE_VECTOR, 10)}, {FUSED_SQL}, {knn_sql(ONE_VECTOR, 12, 'label IN (1, 3)', 'p')},
gd AS (SELECT count(*) FILTER (n >= 3) = 2 AS done FROM (SELECT count(*) AS n FROM fu JOIN embeddings ON vec_id = id WHERE label IN (1, 3) GROUP BY label)),
nw AS (SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, id) AS g FROM px WHERE id NOT IN (SELECT id FROM fu) AND score >= 0.15) WHERE g <= 3 AND NOT (SELECT done FROM gd)),
md AS (SELECT list_sort(list(score))[len(list(score)) // 2 + 1] AS m FROM fu)
SELECT id, score, source FROM fu UNION ALL SELECT id, m, 'injected' FROM nw, md""")
def inject_targeted(t: Tables) -> DataFrame:
    main = settle(fusion.fuse_ranks(*_lists(t, 10)))
    groups = t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("group"))
    pool = _nearest(t, t.embeddings.where(F.col("label").isin(1, 3)), FUSION.inject_pool * 2).drop("rank").join(groups, "id")
    return fusion.inject(main, pool, [1, 3], groups).select("id", "score", "source")


_RANKED_SQL = f"""{bm25_sql(ONE_QUERY, 60)},
rk AS (SELECT lx.id, d2.source AS grp, score, rank, {_HITS_SQL.replace('text', 'd2.text')} AS hits FROM lx JOIN documents d2 ON d2.doc_id = lx.id),
ps AS (SELECT grp, sum((hits >= 2)::INT) AS multi FROM rk GROUP BY grp),
cp AS (SELECT grp, greatest(CASE WHEN grp IN ('src1') THEN 6 ELSE 2 END, CASE WHEN multi >= 3 AND multi / nullif(sum(multi) OVER (), 0) >= 0.3 THEN 4 ELSE 2 END) AS cap FROM ps)"""


def _ranked(t: Tables) -> DataFrame:
    lex = lexical.search_one(t.documents, QUESTION, 60, "doc_id", "text").withColumn("query_id", F.lit(0))
    texts = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), "text")
    hits = fusion.keyword_hits(F.col("text"), F.array(*map(F.lit, TERMS)))
    return lex.join(texts, "id").select("query_id", "id", "group", "score", "rank", hits.alias("hits"))


@query(f"WITH {_RANKED_SQL} SELECT grp AS source, cap::INT AS cap FROM cp")
def cap_overrides(t: Tables) -> DataFrame:
    return fusion.caps(_ranked(t), ["src1"], len(TERMS)).select(F.col("group").alias("source"), "cap")


@query(f"""WITH {_RANKED_SQL},
n AS (SELECT rk.*, cap, hits > 0 AS keyed, row_number() OVER (PARTITION BY grp, hits > 0 ORDER BY rank) AS k, sum((hits > 0)::INT) OVER (PARTITION BY grp) AS kw FROM rk JOIN cp USING (grp)),
s AS (SELECT *, CASE WHEN keyed AND k <= cap THEN 1 WHEN NOT keyed AND k <= cap - least(kw, cap) THEN 2 END AS stage FROM n),
o AS (SELECT *, row_number() OVER (ORDER BY stage, rank) AS pos FROM s WHERE stage IS NOT NULL)
SELECT id, grp AS source, score, stage, pos FROM o WHERE pos <= 12""")
def diversify_two_pass(t: Tables) -> DataFrame:
    ranked = _ranked(t)
    out = fusion.diversify(fusion.with_caps(ranked, ["src1"], len(TERMS)), 12)
    return out.select("id", F.col("group").alias("source"), "score", "stage", "pos")


@query(r"""WITH c AS (SELECT conv_id, turn, len(list_filter(['ing', 'the'], lambda w: contains(lower(text), w))) AS hits, length(text) AS score FROM conversations),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, conv_id, turn) AS pos FROM c QUALIFY pos <= 40),
b AS (SELECT conv_id, pos, score, unnest([turn - 1, turn + 1]) AS turn, unnest([0, 1]) AS side FROM r WHERE hits >= 2),
n AS (SELECT b.*, row_number() OVER (PARTITION BY b.conv_id, b.turn ORDER BY pos, side) AS k FROM b SEMI JOIN c ON b.conv_id = c.conv_id AND b.turn = c.turn ANTI JOIN r ON b.conv_id = r.conv_id AND b.turn = r.turn)
SELECT conv_id, turn, score * 1e0 AS score, false AS added FROM r UNION ALL SELECT conv_id, turn, score * 0.5e0, true FROM n WHERE k = 1""")
def adjacent_expand(t: Tables) -> DataFrame:
    terms = F.array(F.lit("ing"), F.lit("the"))
    chunks = t.conversations.select(F.col("conv_id").alias("prefix"), F.col("turn").alias("number"), F.length("text").cast("double").alias("score"), fusion.keyword_hits(F.col("text"), terms).alias("hits"))
    best = chunks.orderBy(F.desc("score"), "prefix", "number").limit(40)
    pos = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "prefix", "number"))
    results = best.withColumn("query_id", F.lit(0)).withColumn("pos", pos)
    out = fusion.expand_neighbours(results, chunks, 2)
    return out.select(F.col("prefix").alias("conv_id"), F.col("number").alias("turn"), "score", "added")


_TOKSET = "list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 2))"


@query(f"""WITH {bm25_sql(ONE_QUERY, 60)},
c AS (SELECT lx.id, score, {_TOKSET} AS t FROM lx JOIN documents ON doc_id = lx.id),
l AS (SELECT list(struct_pack(id := id, score := score, t := t) ORDER BY score DESC, id) AS a FROM c),
k AS (SELECT list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y:
  len(list_intersect(y.t, x[1].t)) >= 0.6e0 * len(list_distinct(list_concat(y.t, x[1].t))) AND len(list_concat(y.t, x[1].t)) > 0)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM l),
u AS (SELECT unnest(kept) AS x, generate_subscripts(kept, 1) AS rank FROM k)
SELECT x.id AS id, x.score AS score, rank FROM u""")
def dedup_jaccard(t: Tables) -> DataFrame:
    lex = lexical.search_one(t.documents, QUESTION, 60, "doc_id", "text").withColumn("query_id", F.lit(0))
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 2)
    rows = lex.join(t.documents.select(F.col("doc_id").alias("id"), words.alias("tokens")), "id")
    return fusion.drop_near_copies(rows).select("id", "score", "rank")


@query(f"""WITH {knn_sql(ONE_VECTOR, 12)}, od AS (SELECT rank, min(pos) AS pos FROM (VALUES (5, 0), (2, 1), (5, 2), (99, 3), (1, 4)) o(rank, pos) GROUP BY rank)
SELECT id, rank, row_number() OVER (ORDER BY coalesce(pos, 1000000 + rank), rank) AS new_rank, 12 - row_number() OVER (ORDER BY coalesce(pos, 1000000 + rank), rank) + 1 AS score
FROM vx LEFT JOIN od USING (rank)""")
def rerank_apply(t: Tables) -> DataFrame:
    order = t.rows("query_id int, rank int, pos int", [(0, 5, 0), (0, 2, 1), (0, 5, 2), (0, 99, 3), (0, 1, 4)])
    return fusion.apply_order(_nearest(t, t.embeddings, 12), order).drop("query_id")


TARGETS = ("src1",)


def named_speakers(t: Tables, questions: tuple[str, ...]) -> list[str]:
    """Of all speakers those that a question names as whole words; no more than the questions have words."""
    asked = t.rows("q int, text string", list(enumerate(questions)))
    found = automaton.places(asked, t.documents.select(F.col("lang").alias("speaker")), "q", "text", "speaker")
    return sorted(r["name"] for r in found.select("name").distinct().collect())


def hybrid(t: Tables, question: str, query_id: int = 0, kind: str = "interpretive", confidence: float = 0.7, targets=TARGETS, supplemental=SUPPLEMENTAL, synonyms=SYNONYMS) -> DataFrame:
    """The composed pipeline over documents and vectors of the same ids: id, source, score, pos, added.

    Vectors with their topics, and words with their synonyms, give two lists that are
    fused; so do the vector and the words of each supplemental question, whose best
    discounted score is added, as are near rows of the target groups.  Speakers are those that a question names.  Boosts
    and penalties, removal of near copies, diversification, and the documents
    beside strong results follow.  The top-k operators read the tables once each;
    their lists, and the few hundred rows with texts, are settled, so that no
    later step plans them again.
    """
    k = depth(kind, confidence)
    wide_vector, wide_lexical = k.vector * FUSION.widening, k.lexical * FUSION.widening
    chunks = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("group"), F.col("lang").alias("speakers"), "text")
    one = settle(t.embeddings.where(F.col("vec_id") == query_id).select(F.lit(0).alias("query_id"), F.col("embedding").alias("vector")))
    merged = _merged(t, vector.neighbours(t.embeddings, one, wide_vector), wide_vector, query_id).withColumn("query_id", F.lit(0))
    near = settle(lexical.top_per(merged, wide_vector * 2))
    texts = (question, *(q for q, _ in supplemental))
    words = settle(lexical.search(t.documents, t.rows("query_id int, query string", list(enumerate(texts))), wide_lexical, "doc_id", "text", synonyms=synonyms))
    fused = fusion.fuse_ranks(near, words.where("query_id = 0"))
    also = _vectors_near(t, supplemental, wide_vector)
    main = settle(fusion.add_supplemental(fused, fusion.fuse_ranks(also, words.where("query_id > 0")).withColumn("query_id", F.lit(0))))
    speakers = named_speakers(t, texts)
    own = chunks.where(F.col("group").isin(*targets)).select("id", "group")
    of_targets = t.embeddings.join(own.withColumnRenamed("id", "vec_id"), "vec_id", "left_semi")
    pool = settle(vector.neighbours(of_targets, one, FUSION.inject_pool * len(targets)).select("query_id", "id", "score"))
    rows = fusion.inject(main, pool.join(own, "id"), list(targets), own)
    terms = query_terms(F.lit(question))
    hits = fusion.keyword_hits(F.col("text"), terms)
    factor = fusion.keyword_factor(F.col("text"), terms) * fusion.member_factor(F.col("speakers"), speakers, FUSION.speaker_boost) * fusion.group_factor(F.col("group"), list(targets)) * fusion.boilerplate_factor(F.col("text"), BOILERPLATE)
    tokens = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: F.length(x) > 2)
    boosted = settle(chunks.join(F.broadcast(rows), "id").select("query_id", "id", "group", F.round(F.col("score") * factor, 9).alias("score"), hits.alias("hits"), tokens.alias("tokens")))  # a few lists long
    distinct = fusion.drop_near_copies(boosted).join(boosted.select("id", "group", "hits"), "id")
    best = settle(fusion.diversify(fusion.with_caps(distinct, list(targets), len(TERMS)), k.final))
    results = best.select("query_id", F.lit("").alias("prefix"), F.col("id").alias("number"), "score", "pos", "hits")
    beside = chunks.select(F.lit("").alias("prefix"), F.col("id").alias("number"))
    out = fusion.expand_neighbours(results, beside, len(TERMS)).select(F.col("number").alias("id"), F.round("score", 6).alias("score"), "added")
    return out.join(best.select("id", "pos", F.col("group").alias("source")), "id", "left").select("id", "source", "score", "pos", "added")


@query(f"""WITH {bm25_sql(_EXPANDED + " UNION ALL " + _ALSO_SQL, 40)}, {_MERGED_SQL}, {knn_sql(_ALSO_VECTOR, 60, p='s')},
vr AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM mg),
fu AS (SELECT coalesce(v.id, l.id) AS id, round(coalesce(1 / (60 + v.rank), 0e0) + coalesce(1 / (60 + l.rank), 0e0), 6) AS score FROM vr v FULL JOIN (SELECT * FROM lx WHERE query_id = 0) l ON v.id = l.id),
sp AS (SELECT coalesce(v.id, l.id) AS id, 0.7e0 * round(coalesce(1 / (60 + v.rank), 0e0) + coalesce(1 / (60 + l.rank), 0e0), 6) AS more FROM sx v FULL JOIN (SELECT * FROM lx WHERE query_id = 1) l ON v.id = l.id),
ma AS (SELECT coalesce(fu.id, sp.id) AS id, round(coalesce(score, 0) + coalesce(more, 0), 6) AS score FROM fu FULL JOIN sp ON fu.id = sp.id),
{knn_sql(ONE_VECTOR, 6, "vec_id IN (SELECT doc_id FROM documents WHERE source = 'src1')", 'p')},
nw AS (SELECT id FROM px WHERE id NOT IN (SELECT id FROM ma) AND score >= 0.15 AND (SELECT count(*) FROM ma JOIN documents ON doc_id = ma.id WHERE source = 'src1') < 3 ORDER BY score DESC, id LIMIT 3),
al AS (SELECT id, score FROM ma UNION ALL SELECT id, (SELECT list_sort(list(score))[len(list(score)) // 2 + 1] FROM ma) FROM nw),
bo AS (SELECT id, source AS grp, text, {_HITS_SQL} AS hits, round(score * (1 + {_HITS_SQL} * 0.15e0) * CASE WHEN list_contains(string_split('{QUESTION} {SUPPLEMENTAL[0][0]}', ' '), lang) THEN 1.3e0 ELSE 1 END * CASE source WHEN 'src1' THEN 1.5e0 ELSE 1 END
       * CASE WHEN {_BOILER_SQL} >= 2 THEN 0.3e0 WHEN {_BOILER_SQL} = 1 THEN 0.6e0 ELSE 1e0 END, 9) AS score FROM al JOIN documents ON doc_id = id),
dl AS (SELECT list(struct_pack(id := id, score := score, t := {_TOKSET}) ORDER BY score DESC, id) AS a FROM bo),
dk AS (SELECT list_reduce(list_transform(a, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y:
  len(list_intersect(y.t, x[1].t)) >= 0.6e0 * len(list_distinct(list_concat(y.t, x[1].t))) AND len(list_concat(y.t, x[1].t)) > 0)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM dl),
rk AS (SELECT u.x.id AS id, u.x.score AS score, u.rank, grp, hits FROM (SELECT unnest(kept) AS x, generate_subscripts(kept, 1) AS rank FROM dk) u JOIN bo ON bo.id = u.x.id),
pm AS (SELECT grp, sum((hits >= 2)::INT) AS multi FROM rk GROUP BY grp),
cp AS (SELECT grp, greatest(CASE WHEN grp IN ('src1') THEN 6 ELSE 2 END, CASE WHEN multi >= 3 AND multi / nullif(sum(multi) OVER (), 0) >= 0.3 THEN 4 ELSE 2 END) AS cap FROM pm),
ns AS (SELECT rk.*, cap, hits > 0 AS keyed, row_number() OVER (PARTITION BY grp, hits > 0 ORDER BY rank) AS k, sum((hits > 0)::INT) OVER (PARTITION BY grp) AS kw FROM rk JOIN cp USING (grp)),
sg AS (SELECT *, CASE WHEN keyed AND k <= cap THEN 1 WHEN NOT keyed AND k <= cap - least(kw, cap) THEN 2 END AS stage FROM ns),
dv AS (SELECT *, row_number() OVER (ORDER BY stage, rank) AS pos FROM sg WHERE stage IS NOT NULL QUALIFY pos <= 15),
nb AS (SELECT pos, score, unnest([id - 1, id + 1]) AS id, unnest([0, 1]) AS side FROM dv WHERE hits >= 2),
ne AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos, side) AS f FROM nb WHERE id IN (SELECT doc_id FROM documents) AND id NOT IN (SELECT id FROM dv))
SELECT id, grp AS source, round(score, 6) AS score, pos, false AS added FROM dv UNION ALL SELECT id, NULL, round(score * 0.5e0, 6), NULL, true FROM ne WHERE f = 1""")
def hybrid_pipeline(t: Tables) -> DataFrame:
    return hybrid(t, QUESTION)
