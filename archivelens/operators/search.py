"""Hybrid retrieval for a table of queries over a table of chunks.

Queries: query_id, text, vector. Chunks: chunk_id, file_name, source_path, modified_at, chunk_text,
embedding. Chunks can be many and queries are a stated set: blocks of queries meet blocks of chunks, each
pair of blocks reports the best few of each query only, and those are ranked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from archivelens.functions import ranking, scratch, similarity, text
from archivelens.operators import containment

#: Least similarity of a vector hit, vector hits, and candidates of a query.
FLOOR, NEAREST, MOST = 0.3, 12, 16
#: Tasks over which the rows that meet one block of queries are dealt where there are many blocks.
SALTS = 64


def majority_size(chunks: DataFrame) -> DataFrame:
    """Chunks whose vector has the commonest size (ties: the smaller one)."""
    counts = chunks.filter("embedding is not null and size(embedding) > 0").groupBy(F.size("embedding").alias("n")).agg(F.count(F.lit(1)).alias("rows"))
    best = counts.agg(F.max_by("n", F.struct("rows", -F.col("n"))).alias("n"))
    return chunks.filter("embedding is not null").join(F.broadcast(best), F.size("embedding") == F.col("n"), "left_semi")  # one row


def _packed(rows: DataFrame, per: int) -> DataFrame:
    """Rows (scope, id, v) in blocks of ``per`` on average: scope, block, dim, ids (ascending), vectors."""
    kinds = dict(rows.dtypes)

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        values = table.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False)
        ids = pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column("id").chunk(0))
        return pa.table({"scope": [key[0].as_py()], "block": [key[1].as_py()], "dim": [key[2].as_py()], "ids": ids, "vectors": [values.tobytes()]})

    blocks = rows.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / per).alias("blocks"))
    dealt = rows.join(blocks, "scope").select("scope", "id", "v", F.size("v").cast("long").alias("dim"), F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    return dealt.groupBy("scope", "block", "dim").applyInArrow(pack, f"scope {kinds['scope']}, block long, dim long, ids array<{kinds['id']}>, vectors binary")


def nearest(queries: DataFrame, chunks: DataFrame, k: int, floor: float | None = None, block: int = 256, per: int = 2048, sent: int = 64, scoped: bool = False) -> DataFrame:
    """query_id, chunk_id, similarity (rounded to 6 digits), rank of the ``k`` chunks (scope,
    chunk_id, embedding) that are most similar to each query (scope, query_id, vector) of their scope and
    reach ``floor``; ties by chunk_id. ``scoped`` keeps the scope, of which a query may have several.

    Queries and chunks are gathered in blocks, one row each; blocks of a scope are compared by one matrix
    product and report ``k`` rows a query at most. Up to ``sent`` blocks of queries (of bounded size) go
    to the chunks; more are joined by their scope and a salt that deals the chunks' blocks over tasks.
    Null and empty vectors take no part, zero vectors are similar to nothing.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(chunks.dtypes)["chunk_id"]
    ask = _packed(queries.filter("size(vector) > 0").select("scope", F.col("query_id").alias("id"), F.col("vector").cast("array<double>").alias("v")), block)
    held = _packed(chunks.filter("size(embedding) > 0").select("scope", F.col("chunk_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), per)
    ask = scratch.stored(ask.select("scope", "dim", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "queries")
    if ask.count() <= sent:
        met = held.join(F.broadcast(ask), ["scope", "dim"])
    else:
        lent = ask.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        met = held.withColumn("salt", F.pmod("block", F.lit(SALTS))).join(lent, ["scope", "dim", "salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1)
                dim = row.column("dim")[0].as_py()
                q, c = (np.frombuffer(row.column(name)[0].as_buffer()).reshape(-1, dim) for name in ("queries", "vectors"))
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.nan_to_num((q @ c.T) / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(c, axis=1)[None, :]))
                s = np.round(s, 6)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]  # ids ascend, so ties go to smaller ones
                value = np.take_along_axis(s, best, 1)
                i, j = np.nonzero(value >= floor) if floor is not None else np.indices(value.shape).reshape(2, -1)
                scope = row.column("scope").take(pa.array(np.zeros(len(i), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([scope, row.column("query_ids").flatten().take(pa.array(i)), row.column("ids").flatten().take(pa.array(best[i, j])), pa.array(value[i, j])], ["scope", "query_id", "chunk_id", "similarity"])

    found = met.select("scope", "dim", "ids", "vectors", "query_ids", "queries").mapInArrow(compare, f"scope {dict(queries.dtypes)['scope']}, query_id {kinds[0]}, chunk_id {kinds[1]}, similarity double")
    order = Window.partitionBy("scope", "query_id").orderBy(F.desc("similarity"), "chunk_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best if scoped else best.drop("scope")


def vector_topk(queries: DataFrame, chunks: DataFrame, k: int = NEAREST, floor: float | None = FLOOR) -> DataFrame:
    """the ``k`` most similar chunks of each query, ties by chunk_id."""
    return nearest(queries.withColumn("scope", F.lit("")), majority_size(chunks).withColumn("scope", F.lit("")), k, floor)


def one_query_topk(vector: list[float], chunks: DataFrame, k: int = NEAREST, floor: float = FLOOR) -> DataFrame:
    """F7 for one query: expressions alone, then a top-k that needs no sort of all rows."""
    wanted = F.array(*[F.lit(float(x)) for x in vector])
    scored = chunks.select("chunk_id", "source", F.round(similarity.cosine(F.col("embedding"), wanted), 6).alias("similarity"))
    return scored.filter(F.col("similarity") >= floor).orderBy(F.desc("similarity"), "chunk_id").limit(k)


def index(chunks: DataFrame, stopwords: Sequence[str] = (), suffixes: Sequence[str] = ()) -> DataFrame:
    """token, source_key: the inverted index of names and paths (H5)."""
    names = F.concat_ws(" ", "file_name", "source_path")
    return chunks.select("source_path", F.explode(text.source_tokens(names, stopwords, suffixes)).alias("token")).select("token", F.col("source_path").alias("source_key")).distinct()


def indexed_terms(terms: DataFrame, tokens: DataFrame) -> DataFrame:
    """Rows of (query_id, term) whose term is a token of some source."""
    return terms.join(tokens.select(F.col("token").alias("term")).distinct(), "term", "left_semi")


def term_hits(terms: DataFrame, chunks: DataFrame, target: str, name: str) -> DataFrame:
    """query_id, chunk_id, ``name``: how many (lower-cased) terms of a query occur in a column.

    Terms are looked up by their rarest grams (``containment``), those of all queries at once.
    """
    found = containment.matches(chunks.select("chunk_id", target), target, terms.select(F.col("term").alias("keyword")))
    asked = terms.select("query_id", F.col("term").alias("matched")).distinct()
    return found.join(asked, "matched").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).cast("int").alias(name))


def exact_name_hits(source_terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, chunk_id, hits of the chunks whose file name holds most of a query's source terms,
    also inside its words. Names are searched once each and joined back to their chunks."""
    names = chunks.select(F.col("file_name").alias("chunk_id"), "file_name").filter("file_name is not null").distinct()
    asked, members = questions(source_terms)
    best = best_count(term_hits(asked, names, "file_name", "hits"), ["query_id"], "hits")
    best = best.withColumnRenamed("chunk_id", "file_name").join(chunks.select("chunk_id", "file_name"), "file_name")
    return lent(best.select("query_id", "chunk_id", "hits"), members)


def content_hits(source_terms: DataFrame, content_terms: DataFrame, chunks: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """query_id, chunk_id, hits, source_hits of the chunks whose name and path have all source terms
    of a query but one at most (and one at least), and whose text holds any of its content terms.

    Sources are matched first, by an equi-join on tokens; only their texts are searched."""
    tokens = chunks.select("chunk_id", F.explode(text.source_tokens(F.concat_ws(" ", "file_name", "source_path"), stopwords)).alias("term"))
    wanted = source_terms.groupBy("query_id").agg(F.greatest(F.lit(1), F.count(F.lit(1)) - 1).alias("least"))
    matched = source_terms.join(tokens, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("source_hits")).join(wanted, "query_id").filter("source_hits >= least")
    lists = content_terms.groupBy("query_id").agg(F.collect_set("term").alias("terms"))
    rows = matched.join(lists, "query_id").join(chunks.select("chunk_id", F.lower("chunk_text").alias("target")), "chunk_id")
    rows = rows.withColumn("hits", F.size(F.filter("terms", lambda t: F.contains(F.col("target"), t))))
    return rows.filter("hits > 0").select("query_id", "chunk_id", "hits", "source_hits")


def questions(terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Queries with one set of terms are asked once: query_id, term of one of each such set (terms: query_id, term),
    and all queries (query_id) beside the one that is asked for them (question)."""
    own = terms.select("query_id", "term").distinct().groupBy("query_id").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    own = scratch.stored(own, "asked")
    first = scratch.stored(own.groupBy("terms").agg(F.min("query_id").alias("question")), "questions")
    return first.select(F.col("question").alias("query_id"), F.explode("terms").alias("term")), own.join(first, "terms").select("query_id", "question")


def lent(found: DataFrame, members: DataFrame) -> DataFrame:
    """query_id, chunk_id, hits of all queries out of those of the ones that were asked. What is found is dealt over
    ``SALTS`` tasks for each question, and isn't shuffled once it is spread over queries."""
    salts = members.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = found.select(F.col("query_id").alias("question"), "chunk_id", "hits", F.pmod(F.xxhash64("chunk_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(salts, ["question", "salt"]).select("query_id", "chunk_id", "hits")


def best_count(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    """F8: rows that tie at the largest count of their group."""
    return rows.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc(count)))).filter("place = 1").drop("place")


def best_token_match(terms: DataFrame, chunks: DataFrame, stopwords: Sequence[str] = ()) -> DataFrame:
    """query_id, chunk_id, hits of the chunks whose name and path share most tokens with the
    query; an equi-join on tokens."""
    tokens = chunks.select("chunk_id", F.explode(text.source_tokens(F.concat_ws(" ", "file_name", "source_path"), stopwords)).alias("term"))
    asked, members = questions(terms)
    hits = asked.join(tokens, "term").groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("hits"))
    return lent(best_count(hits, ["query_id"], "hits"), members)


def merge_candidates(lists: DataFrame, most: int = MOST) -> DataFrame:
    """distinct chunks of each query in order of (list_no, position), at most ``most``."""
    first = lists.groupBy("query_id", "chunk_id").agg(F.min(F.struct("list_no", "position")).alias("first"))
    order = Window.partitionBy("query_id").orderBy("first.list_no", "first.position", "chunk_id")
    return first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("query_id", "chunk_id", F.col("first.list_no").alias("list_no"), "rank")


def priority_merge(rows: DataFrame, k: int) -> DataFrame:
    """by priority, secondary, keyword hits, content hits and similarity, all descending."""
    order = Window.partitionBy("query_id").orderBy(*[F.desc(c) for c in ("priority", "secondary", "keyword_hits", "content_hits", "similarity")], "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hybrid(queries: DataFrame, chunks: DataFrame, stopwords: Sequence[str] = (), floor: float = FLOOR) -> DataFrame:
    """query_id, chunk_id, list_no, similarity, rank: candidates of each query: content hits (list 0),
    the vector top-k (list 1), exact name hits (list 2); of the first and last the 5 most similar, which
    need not reach the floor.

    Terms are matched once for each distinct question; similarities are taken of what they find only.
    """
    chunks = majority_size(chunks)
    asked = queries.withColumn("scope", F.col("text"))
    terms = asked.select(F.col("scope").alias("query_id"), F.explode(text.match_terms(F.col("text"), stopwords)).alias("term")).distinct()
    source_terms = scratch.stored(indexed_terms(terms, index(chunks, stopwords)), "terms")
    content_terms = terms.join(source_terms, ["query_id", "term"], "left_anti")
    vectors = chunks.select("chunk_id", "embedding")
    # content and name hits are ranked side by side, under a question's text with the list's number before it
    lists = {0: content_hits(source_terms, content_terms, chunks, stopwords), 2: exact_name_hits(source_terms, chunks)}
    hits = [found.select(F.concat(F.lit(f"{n} "), "query_id").alias("scope"), "chunk_id") for n, found in lists.items()]
    hits = hits[0].unionByName(hits[1]).join(vectors, "chunk_id")
    own = [queries.withColumn("scope", F.concat(F.lit(f"{n} "), "text")) for n in lists]
    found = nearest(own[0].unionByName(own[1]), hits, 5, scoped=True)
    rows = found.select("query_id", "chunk_id", "similarity", F.substring("scope", 1, 1).cast("int").alias("list_no"), F.col("rank").alias("position"))
    near = nearest(queries.withColumn("scope", F.lit("")), vectors.withColumn("scope", F.lit("")), NEAREST, floor)
    rows = rows.unionByName(near.select("query_id", "chunk_id", "similarity", F.lit(1).alias("list_no"), F.col("rank").alias("position")))
    rows = scratch.stored(rows, "candidates")
    return merge_candidates(rows).join(rows.select("query_id", "chunk_id", "similarity").distinct(), ["query_id", "chunk_id"])


def confidence(top: Column) -> Column:
    """Label of the best similarity."""
    return F.when(top >= 0.55, "certain").when(top >= 0.42, "estimated").otherwise("check")


def weakest(labels: DataFrame, keys: list[str]) -> DataFrame:
    """The weakest label of each group."""
    scale = F.when(F.col("confidence") == "check", 0).when(F.col("confidence") == "estimated", 1).otherwise(2)
    return labels.groupBy(*keys).agg(F.min_by("confidence", scale).alias("confidence"))


def answerable(best: DataFrame) -> DataFrame:
    """By query (is_external, is_file_like, name_match, top_similarity): external facts never;
    a query like a file name needs a match of 0.58; others that or a similarity of 0.34."""
    named = F.col("name_match") >= 0.58
    gate = F.when(F.col("is_external"), False).when(F.col("is_file_like") & ~named, False).otherwise(named | (F.col("top_similarity") >= 0.34))
    return best.withColumn("answerable", gate)


def split_evidence(rows: DataFrame, primary: int = 3, related: int = 1) -> DataFrame:
    """the best row of each source of a query by (name_match, overlap, similarity), then roles
    by rank: primary, related; the rest goes."""
    by = [F.desc("name_match"), F.desc("overlap"), F.desc("similarity")]
    one = rows.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "source_path").orderBy(*by, "chunk_id"))).filter("n = 1")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*by, "source_path"))).filter(F.col("rank") <= primary + related)
    return ranked.withColumn("role", F.when(F.col("rank") <= primary, "primary").otherwise("related")).drop("n")


def supplement(rows: DataFrame, used: DataFrame, most: int = 1) -> DataFrame:
    """F16: unused chunks with at least two query terms in the file name, by (name hits, similarity)."""
    left = rows.filter("name_hits >= 2").join(used, ["query_id", "source_path"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("name_hits"), F.desc("similarity"), "chunk_id"))).filter(F.col("rank") <= most)


def keyword_summary(hits: DataFrame, least: int = 10, most: int = 80) -> DataFrame:
    """Of queries that hit more than ``least`` sources, the number of sources, the first names
    and how many are left out. Only the listed names are gathered."""
    one = hits.select("query_id", "source_path").distinct()
    totals = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources")).filter(F.col("sources") > least)
    listed = one.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("source_path"))).filter(F.col("rank") <= most)
    names = listed.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("source_path")), "\n").alias("names"))
    return totals.join(names, "query_id").withColumn("omitted", F.greatest(F.col("sources") - most, F.lit(0)))


def date_ranking(query_text: Column, chunks: DataFrame, queries: DataFrame, default: int = 5) -> DataFrame:
    """for date-ranking queries, the latest sources; n is the first number in the query, else 5. A number of
    any length counts; one beyond all sources gives them all. Many sources are ranked by many tasks."""
    digits = F.nullif(F.regexp_extract(query_text, r"([0-9]+)", 1), F.lit(""))
    all_ = F.lit((1 << 31) - 1)
    number = F.when(digits.isNull(), default).otherwise(F.least(F.coalesce(digits.try_cast("long"), all_.cast("long")), all_)).cast("int")
    wanted = queries.select("query_id", number.alias("n"), F.lit(0).alias("one"))
    latest = chunks.groupBy("source_path").agg(F.max("modified_at").alias("modified_at"))
    most = wanted.agg(F.max("n")).head()[0] or 0  # one number
    top = latest.orderBy(F.desc_nulls_last("modified_at"), "source_path").limit(most).withColumn("one", F.lit(0))
    ranked = ranking.placed(top, ["one"], [F.desc_nulls_last("modified_at"), F.col("source_path")])
    return wanted.join(ranked, "one").filter("rank <= n").select("query_id", "source_path", "modified_at", "rank")


def best_name_match(rows: DataFrame, fillers: Sequence[str] = similarity.FILLERS) -> DataFrame:
    """H7: query_id, name_match: the best match of a query (text) among the names (file_name) of its rows: 1 if
    either key holds the other, else the greatest sequence ratio; 0 without a key. Each two keys are compared once."""
    keyed = rows.select("query_id", similarity.name_key(F.col("text"), fillers).alias("q"), similarity.name_key(F.col("file_name"), fillers).alias("n"))
    pairs = keyed.select("q", "n").filter("q <> '' and n <> ''").distinct()
    inside = F.contains("q", F.col("n")) | F.contains("n", F.col("q"))
    apart = pairs.filter(~inside)
    scored = pairs.filter(inside).withColumn("ratio", F.lit(1.0)).unionByName(apart.withColumn("ratio", similarity.seq_ratio("q", "n")))
    return keyed.join(scored, ["q", "n"], "left").groupBy("query_id").agg(F.coalesce(F.max("ratio"), F.lit(0.0)).alias("name_match"))


def split_compound(queries: DataFrame, conjunctions: Sequence[str], endings: Sequence[str]) -> DataFrame:
    """H6: query_id, part_no, part: a query that has a conjunction and ends as a request, in parts."""
    low = F.lower("text")
    compound = F.regexp_like(low, F.lit("|".join(conjunctions))) & F.exists(F.array(*map(F.lit, endings)), lambda e: F.endswith(F.rtrim(F.regexp_replace(low, r"[.!?\s]+$", "")), e))
    parts = F.filter(F.transform(F.split("text", "(?i)(?:" + "|".join(conjunctions) + ")"), F.trim), lambda p: F.length(p) >= 2)
    return queries.select("query_id", F.posexplode(F.when(compound, parts).otherwise(F.array("text"))).alias("part_no", "part"))


def route(queries: DataFrame, date_words: Sequence[str], conjunctions: Sequence[str], endings: Sequence[str]) -> DataFrame:
    """Route of each query: date_ranking, compound or search."""
    low = F.lower("text")
    dated = F.exists(F.array(*map(F.lit, date_words)), lambda w: F.contains(low, w))
    parts = split_compound(queries, conjunctions, endings).groupBy("query_id").agg(F.count(F.lit(1)).alias("parts"))
    return queries.join(parts, "query_id").withColumn("route", F.when(dated, "date_ranking").when(F.col("parts") > 1, "compound").otherwise("search"))


def resolve_sources(cited: DataFrame, known: DataFrame) -> DataFrame:
    """Cited strings as known sources: by exact name or path first, else by containment of a
    known name among the query's own sources (an equi-join on query_id)."""
    exact = cited.join(known, "query_id").filter((F.lower("cited") == F.lower("file_name")) | (F.lower("cited") == F.lower("source_path")))
    rest = cited.join(exact.select("query_id", "cited").distinct(), ["query_id", "cited"], "left_anti")
    near = rest.join(known, "query_id").filter(F.contains(F.lower("cited"), F.lower("file_name")) | F.contains(F.lower("file_name"), F.lower("cited")))
    both = exact.withColumn("how", F.lit("exact")).unionByName(near.withColumn("how", F.lit("contains")))
    return both.withColumn("n", F.row_number().over(Window.partitionBy("query_id", "cited").orderBy("source_path"))).filter("n = 1").drop("n")


def pack_context(hits: DataFrame) -> DataFrame:
    """The text given to a model for each query: hits grouped by file in order of the best rank,
    files and their chunks numbered. A query's hits are bounded by its candidate limit."""
    files = hits.groupBy("query_id", "file_name", "source_path").agg(F.min("rank").alias("first"), F.array_sort(F.collect_list(F.struct("rank", "chunk_text"))).alias("held"))
    files = files.withColumn("file_no", F.row_number().over(Window.partitionBy("query_id").orderBy("first", "source_path")))
    body = F.array_join(F.transform("held", lambda c, i: F.concat(F.lit("("), (i + 1).cast("string"), F.lit(") "), c["chunk_text"])), "\n")
    files = files.withColumn("block", F.concat(F.lit("[File "), F.col("file_no").cast("string"), F.lit("] "), "file_name", F.lit("\n"), body))
    return files.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_no", "block"))), lambda b: b["block"]), "\n\n").alias("context"))


def text_hits_with_source(terms: DataFrame, source_terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """of queries with at least two terms, chunks that tie at most source terms in name and path and
    hold at least one of the other terms in their text."""
    two = terms.groupBy("query_id").agg(F.countDistinct("term").alias("n")).filter("n >= 2").select("query_id")
    content = terms.join(source_terms, ["query_id", "term"], "left_anti").join(two, "query_id", "left_semi")
    return best_token_match(source_terms, chunks).join(term_hits(content, chunks, "chunk_text", "content_hits"), ["query_id", "chunk_id"])


def placeholder_only(rows: DataFrame, placeholder: Column, most: int = 10) -> DataFrame:
    """Queries whose best rows (source_hits, similarity of 0.5 or more) are all placeholders, with
    the first sources found but not readable."""
    best = best_count(rows.filter("similarity >= 0.5").withColumn("placeholder", placeholder), ["query_id"], "source_hits")
    flagged = best.groupBy("query_id").agg(F.bool_and("placeholder").alias("all")).filter(F.col("all")).select("query_id")
    first = best.join(flagged, "query_id", "left_semi").select("query_id", "source_path").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("source_path"))).filter(F.col("rank") <= most)
    return first.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list("source_path")), "\n").alias("sources"))
