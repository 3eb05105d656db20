"""The queries of this library by name, each (spark, sf_dir) -> DataFrame over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vx
from ..operators import catalog, classify, compaction, cost, encoder, fusion, graph, graph_build, history, lexical_index, prep, semi, spelling, tags, vector, vector_index
from ..operators import diagnose as dx
from ..operators import formatting as fm
from ..sources import adapters as ad
from ..sources import files, sinks
from ..sources.scratch import own_folder, written
from ..sources.versioned import Table
from ..streaming import stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AS_OF_DAYS, AS_OF_QUARTERS, MONTH = "2024-01-31", "2001-08-01", "1997-12"
JOIN = ","


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(c, sep: str = JOIN):
    return F.array_join(c, sep)


@query
def scan_project_default(s, d):
    docs, labels = ad.table(s, d, "documents"), ad.table(s, d, "labels")
    return docs.join(labels, "doc_id", "left").select(
        "doc_id", tx.prefix(F.col("text"), 30).alias("head"), F.length("text").alias("n"), tx.or_else(F.col("quality"), -1).alias("quality"),
        tx.falsy_or(F.nullif("lang", F.lit("en")), F.lit("default")).alias("lang"),
    )


@query
def filter_eq_range(s, d):
    e = ad.history_days(s, d)
    recent = history.recent(e, AS_OF_DAYS, 7).where(F.col("query") == "click").select(F.lit("recent").alias("part"), "id")
    o = ad.history_quarters(s, d)
    start = F.lit(f"{MONTH}-01").cast("timestamp_ntz")
    month = o.where((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 MONTH"))).select(F.lit("month").alias("part"), "id")
    return recent.unionByName(month).unionByName(history.old(o, "1995-06-01").select(F.lit("old").alias("part"), "id"))


@query
def fuzzy_contains(s, d):
    """Which benchmark texts fuzzily hold the short title of which document."""
    targets = ad.chunks(s, d).select(F.col("chunk_id").alias("doc_id"), F.col("short_title").alias("target"))
    pairs = tx.fuzzy_pairs(ad.queries(s, d), targets)
    return pairs.join(targets, "target").groupBy("query_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.sum("doc_id").cast("double").alias("sum_doc"))


@query
def keyword_any_case(s, d):
    return ad.table(s, d, "documents").select("doc_id", classify.complexity(F.col("text")).alias("complexity"))


@query
def grade_argmax(s, d):
    return ad.table(s, d, "documents").select("doc_id", classify.grade(F.col("text")).alias("grade"))


_indexes: dict[tuple, str] = {}


def _stored(s, d, name, write):
    """Place of an index of a table: written when a program first asks for it, and anew when the table's files have changed."""
    state = (s.sparkContext.applicationId, d, name, files.state_of(s, f"{d}/{name}.parquet"))
    if state not in _indexes:
        path = own_folder(s)
        write(path)
        _indexes[state] = path
    return _indexes[state]


def _vector_index(s, d):
    return vector_index.read_index(s, _stored(s, d, "embeddings", lambda path: vector_index.write_index(ad.vectors(s, d), path)))


@query
def knn_topk(s, d):
    found = vector_index.search(ad.query_vectors(s, d), _vector_index(s, d), 30, exclude_self=True)
    return found.select("query_id", F.col("pos").alias("vec_id"), "score", "rank")


@query
def vector_index_reads(s, d):
    """How many of the index's clusters and vectors each query of knn_topk needs."""
    return vector_index.reads(ad.query_vectors(s, d), _vector_index(s, d), 30, exclude_self=True)


@query
def vector_index_clusters(s, d):
    """All vectors of the index, counted by cluster, and what the clusters' table says of them."""
    index = _vector_index(s, d)
    held = index.vectors.groupBy("cluster").agg(F.count("*").alias("n_held"), F.count_distinct("pos").alias("n_pos"))
    both = held.join(index.clusters, "cluster")
    return both.agg(F.sum("n_held").alias("n_vectors"), F.sum("n_pos").alias("n_pos"), F.count_if(F.col("n_held") != F.col("n")).alias("n_wrong"))


@query
def l2_normalize(s, d):
    v = ad.vectors(s, d).withColumn("doubled", F.transform("embedding", lambda x: x * 2))
    unit = vx.l2_normalize(F.col("doubled"))
    return v.select(F.col("pos").alias("vec_id"), F.round(vx.norm(F.col("doubled")), 5).alias("norm"), F.round(F.get(unit, F.lit(0)), 5).alias("first"), F.round(vx.norm(unit), 5).alias("unit_norm"))


def _lexical_index(s, d):
    docs = ad.table(s, d, "documents").select("doc_id", "text")
    return lexical_index.read_index(s, _stored(s, d, "documents", lambda path: lexical_index.write_index(docs, path)))


def _lexical(s, d):
    return lexical_index.search(ad.queries(s, d), _lexical_index(s, d), 10)


@query
def tfidf_topk(s, d):
    return _lexical(s, d).select("query_id", "chunk_id", "score", "rank")


@query
def lexical_lexicon(s, d):
    """The terms of the stored index."""
    lexicon = _lexical_index(s, d).lexicon
    return lexicon.select("term", "df", F.round("idf", 6).alias("idf"), F.round("top", 6).alias("top"))


def _tags(s, d, c):
    return tags.search(ad.queries(s, d), c, ad.nodes(c), ad.patterns(c), 30)


def _chunks(s, d):
    """The chunks as a written table: several channels and the rerank read them."""
    return written(ad.chunks(s, d))


@query
def tag_score_topk(s, d):
    return _tags(s, d, _chunks(s, d)).select("query_id", "chunk_id", "score", "rank")


def _channels(s, d, c):
    v = vector_index.search(ad.query_vectors(s, d), _vector_index(s, d), 30).select("query_id", F.col("pos").alias("chunk_id"), "rank", F.lit("vector").alias("channel"))
    # as tables: a union of channels that are all dealt by query would keep that dealing, which adaptive execution may then change under it
    return [written(x) for x in (v, _tags(s, d, c), _lexical(s, d))]


@query
def rrf_fusion(s, d):
    return fusion.fuse(_channels(s, d, _chunks(s, d)))


@query
def rerank_bonus(s, d):
    c = _chunks(s, d)
    ranked = fusion.rerank(fusion.fuse(_channels(s, d, c)), c, ad.queries(s, d))
    return ranked.select("query_id", "chunk_id", "rrf_score", "rerank_bonus", "final_score", "final_rank")


@query
def hybrid_retrieve(s, d):
    c = _chunks(s, d)
    found = fusion.retrieve(_channels(s, d, c), c, ad.queries(s, d), 10)
    return found.select("query_id", "chunk_id", "first_channel", "final_score", "final_rank", "video_id", "part_no")


@query
def hybrid_retrieve_filtered(s, d):
    c = _chunks(s, d)
    found = fusion.retrieve(_channels(s, d, c), c, ad.queries(s, d), 10, F.col("collection") == "en")
    return found.select("query_id", "chunk_id", "first_channel", "final_score", "final_rank")


@query
def last_wins(s, d):
    """Turns as chunks that share an id: of each conversation the last one counts."""
    c = ad.table(s, d, "conversations").select(F.col("conv_id").alias("chunk_id"), "turn", "role", "text")
    return fusion.last_rows(c, F.col("turn")).select(F.col("chunk_id").alias("conv_id"), "turn", "role", F.md5(F.encode("text", "UTF-8")).alias("md5"))


@query
def lookup_left_default(s, d):
    sizes = ad.table(s, d, "part").select(F.col("p_partkey").alias("hit"), (F.col("p_size") % 30).alias("n_nationkey"))
    nation = ad.table(s, d, "nation").select("n_nationkey", "n_name")
    return dx.lookup(sizes, nation, "n_nationkey", {"n_name": ""}).select("hit", F.col("n_name").alias("category"))


@query
def first_match_inner(s, d):
    sizes = ad.table(s, d, "part").select(F.col("p_partkey").alias("hit"), (F.col("p_size") % 7).alias("n_regionkey"))
    return dx.first_match(sizes, ad.table(s, d, "nation"), "n_regionkey", "n_nationkey").select("hit", F.col("n_name").alias("name"))


@query
def bfs_prereqs(s, d):
    nodes = ad.graph_nodes(s, d)
    roots = nodes.select(F.col("node_id").alias("query_id"), F.lit(0).alias("root_at"), "node_id")
    found = graph.trace(roots, graph.edges_of(nodes), 3)
    return found.select("query_id", "node_id", "depth", joined(F.transform(F.slice("path", F.lit(2), F.size("path")), lambda x: x.cast("string")), "/").alias("path"))


def _diagnosed(s, d):
    q = ad.queries(s, d)
    v, qv = ad.vectors(s, d), ad.query_vectors(s, d)
    graph_nodes = ad.graph_nodes(s, d)
    # of each index the rows with metadata: position = key
    of_nodes = v.join(graph_nodes.select(F.col("node_id").alias("pos")), "pos", "left_semi")
    node_index = vector_index.read_index(s, _stored(s, d, "part", lambda path: vector_index.write_index(of_nodes, path)))
    near_nodes = vector_index.search(qv, node_index, 5).select("query_id", F.col("pos").alias("node_id"), "rank")
    nation, region = ad.table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("pos"), "n_name"), ad.table(s, d, "region").select(F.col("r_regionkey").cast("long").alias("pos"), "r_name")
    near_patterns = vector.search(qv, v.join(nation.select("pos"), "pos", "left_semi"), 3).join(nation, "pos").select("query_id", F.col("n_name").alias("pattern_id"), "rank")
    near_techniques = vector.search(qv, v.join(region.select("pos"), "pos", "left_semi"), 5).join(region, "pos").select("query_id", F.col("r_name").alias("technique_id"), "rank")
    c = _chunks(s, d)
    ranked = written(fusion.retrieve(_channels(s, d, c), c, q, 8))  # read for chunks and for videos
    # hits as tables too: nodes are read for the list and for the tracing
    hits = [written(x) for x in (near_nodes, near_patterns, near_techniques)]
    return dx.diagnose(q, *hits, ranked, graph.edges_of(graph_nodes))


@query
def diagnose_full(s, d):
    out = _diagnosed(s, d)

    def text_of(c):
        return joined(F.transform(c, lambda x: x.cast("string")))

    return out.select(
        "query_id", "grade", "complexity", text_of("related_nodes").alias("related_nodes"), text_of("missing_prereqs").alias("missing_prereqs"),
        F.size("prereq_chain").alias("n_chain"), joined("exam_patterns").alias("exam_patterns"), joined("techniques").alias("techniques"),
        F.size("chunks").alias("n_chunks"), F.size("videos").alias("n_videos"),
    )


@query
def video_dedup(s, d):
    """Of each collection (as query) the first five distinct videos in order of chunk."""
    c = ad.chunks(s, d).withColumn("query_id", F.col("collection"))
    return dx.videos(c, 5, "chunk_id").select("query_id", fm.video_key(F.col("video_id"), F.col("part_no")).alias("video"), "chunk_id", "video_rank")


@query
def profile_left(s, d):
    ids = ad.table(s, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return history.profiles(ids, ad.users(s, d), ad.profiles(s, d)).select("user_id", "grade", "school", joined("weak_topics").alias("weak"), joined("mastered_topics").alias("mastered"), "learning_goals")


@query
def upsert_partial(s, d):
    new = ad.table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderpriority").alias("grade"))
    new = new.unionByName(s.createDataFrame([(-1, "new")], "user_id long, grade string"))
    stored = Table.create(ad.users(s, d), own_folder(s), "user_id", ["user_id"])
    stored.merge(new)
    return stored.read()


@query
def array_union_cap(s, d):
    new = ad.table(s, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("new"))
    return new.join(ad.profiles(s, d), "user_id", "left").select("user_id", joined(history.merged_topics(F.col("weak_topics"), F.col("new"), 4)).alias("topics"))


@query
def recent_history_text(s, d):
    h = ad.history_days(s, d)
    return history.recent_text(h.select("user_id").distinct(), h, AS_OF_DAYS)


def _compaction(s, d):
    h = ad.history_quarters(s, d)
    done = ad.users(s, d).where("grade = 'BUILDING'").select("user_id", F.lit("1996-Q1").alias("period"))
    return history.compact(h, done, AS_OF_QUARTERS)


@query
def static_memory_text(s, d):
    made, _, _ = _compaction(s, d)
    u = ad.users(s, d)
    profiled = history.profiles(u.select("user_id"), u, ad.profiles(s, d))
    return history.static_text(profiled, made.select("user_id", "period", "summary"))


@query
def full_memory_text(s, d):
    u = ad.users(s, d)
    profiled = history.profiles(u.select("user_id"), u, ad.profiles(s, d))
    static = history.static_text(profiled, s.createDataFrame([], "user_id long, period string, summary string"))
    return history.full_text(static, history.recent_text(u.select("user_id"), ad.history_days(s, d), AS_OF_DAYS))


@query
def compaction_status(s, d):
    return history.compaction_status(ad.history_quarters(s, d), AS_OF_QUARTERS)


@query
def quarter_groups(s, d):
    rows = history.old(ad.history_quarters(s, d), AS_OF_QUARTERS)
    return rows.groupBy("user_id", history.period(F.col("created_at")).alias("period")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query
def quarter_compaction(s, d):
    made, left, totals = _compaction(s, d)
    rest = left.groupBy("user_id").agg(F.count("*").alias("n_left"))
    counted = made.groupBy("user_id").agg(F.count("*").alias("n_periods"), F.max("compression_ratio").alias("max_ratio"), F.min("summary").alias("min_summary"))
    return totals.join(counted, "user_id").join(rest, "user_id", "left").select("user_id", "n_rows", "cost", "periods", "n_periods", "max_ratio", "min_summary", F.coalesce("n_left", F.lit(0)).alias("n_left"))


@query
def stored_compaction(s, d):
    """Compaction of stored tables: what is left of each user's rows, and their summaries."""
    folder = own_folder(s)
    rows = Table.create(ad.history_quarters(s, d), f"{folder}/history", "user_id", ["id"])
    empty = s.createDataFrame([], "user_id long, period string, summary string, compressed_count long, compression_ratio string")
    summaries = Table.create(empty, f"{folder}/summaries", "user_id", ["user_id", "period"])
    compaction.run(s, rows, summaries, f"{folder}/ledger", "first", AS_OF_QUARTERS)
    compaction.run(s, rows, summaries, f"{folder}/ledger", "first", AS_OF_QUARTERS)  # again: nothing
    left = rows.read().groupBy("user_id").agg(F.count("*").alias("n_left"), F.min("id").alias("first_left"))
    made = summaries.read().groupBy("user_id").agg(F.count("*").alias("n_periods"), F.sum("compressed_count").alias("n_rows"), F.max("compression_ratio").alias("max_ratio"), F.min("summary").alias("min_summary"))
    return made.join(left, "user_id", "full_outer").select(
        "user_id", *[tx.or_else(F.col(c), 0).alias(c) for c in ("n_periods", "n_rows", "n_left", "first_left")], "max_ratio", "min_summary",
    )


@query
def month_cost(s, d):
    return history.month_cost(ad.history_quarters(s, d), MONTH)


@query
def daily_stats(s, d):
    return history.daily_stats(ad.history_days(s, d))


@query
def rolling_users(s, d):
    """Distinct users of the 30 days up to each day: exact, and whether merged daily sketches keep within their bound."""
    return history.rolling_users(ad.history_days(s, d)).select(F.col("until").cast("timestamp_ntz").alias("until"), "users", "n_days", F.expr("abs(sketched - users) <= bound").alias("within_bound"))


def _event_stream(s, d):
    """The events as a stream of its files; an error event is a reset of the session."""
    e = s.readStream.schema(ad.table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern: a stream's path must be a folder otherwise
    return e.select("user_id", F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("cost"), (F.col("event_type") == "error").alias("reset"))


@query
def event_sessions(s, d):
    """Sessions of the event stream by a 60-minute pause or a reset: those closed when the stream has been read."""
    found = stream.run_available(stream.sessions(_event_stream(s, d)), own_folder(s))
    return found.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "session_queries", "session_cost", "closed_by")


@query
def stream_daily(s, d):
    """Daily windows of the event stream: those that are final when it has been read."""
    found = stream.run_available(stream.daily(_event_stream(s, d)), own_folder(s))
    return found.select(F.col("day").cast("timestamp_ntz").alias("day"), "total_queries", "total_cost")


@query
def stream_rolling(s, d):
    """Queries of each user in the 7 days up to each day, from the event stream: the windows that are final."""
    found = stream.run_available(stream.rolling(_event_stream(s, d), "7 days"), own_folder(s))
    return found.select("user_id", F.col("until").cast("timestamp_ntz").alias("until"), "n")


ALL_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@query
def catalog_counts(s, d):
    return catalog.counts({t: ad.table(s, d, t) for t in ALL_TABLES}).where(F.col("name").like("%e%") | F.col("name").isin("part", "labels"))


@query
def expected_minus_present(s, d):
    """Which of the hosts that the documents' sources name, by number, no page comes from."""
    number = F.regexp_extract("source", "[0-9]+", 0)
    expected = ad.table(s, d, "documents").select(F.concat(F.lit("/"), F.coalesce("lang", F.lit("und")), F.lit("/"), number).alias("name")).distinct()
    present = ad.table(s, d, "pages").select(F.col("url").alias("path"), F.length("html").alias("length"))
    return catalog.missing(expected, present)


@query
def fk_violations(s, d):
    """Among references that hold and one that doesn't: not every document is labelled."""
    refs = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("labels", "doc_id", "documents", "doc_id"), ("documents", "doc_id", "labels", "doc_id")]
    out = None
    for child, key, parent, parent_key in refs:
        one = catalog.violations(ad.table(s, d, child), key, ad.table(s, d, parent), parent_key, f"{child}->{parent}")
        out = one if out is None else out.unionByName(one)
    return out


@query
def file_bytes(s, d):
    return files.file_list(s, d, "*.parquet").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


@query
def llm_cost(s, d):
    priced = cost.cost(ad.usage(s, d), cost.providers(s))
    return priced.select("l_orderkey", "l_linenumber", "provider", "cost")


@query
def error_class(s, d):
    """Class of each turn's text, read as a provider's message."""
    return ad.table(s, d, "conversations").select("conv_id", "turn", cost.error_class(F.col("text")).alias("class"))


def _returned(part):
    """A model name for each line's part."""
    return F.when(part % 3 == 0, F.concat(F.lit("Model-A-Pro-"), part.cast("string"))).when(part % 3 == 1, F.lit("model-a-lite")).otherwise(F.lit("anything"))


@query
def model_check(s, d):
    """Whether each line's model is the one that its provider was asked for."""
    provider = F.concat(F.lit("p"), (F.col("l_partkey") % 8 + 1).cast("string"))
    return ad.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", cost.model_ok(provider, _returned(F.col("l_partkey"))).alias("ok"))


@query
def session_running_totals(s, d):
    chat = ad.table(s, d, "conversations").select("conv_id", "turn", F.length("text").cast("double").alias("cost"))
    a = history.running_totals(chat, "conv_id", ["turn"]).select(F.col("conv_id").alias("session"), F.col("turn").alias("step"), "session_cost", "session_queries")
    b = history.running_totals(ad.history_days(s, d), "user_id", ["created_at", "id"]).select((-F.col("user_id") - 1).alias("session"), F.col("id").alias("step"), "session_cost", "session_queries")
    return a.unionByName(b)


@query
def mean_except_first(s, d):
    return history.mean_except_first(ad.history_days(s, d), "user_id", ["created_at", "id"], "cost")


@query
def monotone_check(s, d):
    e = ad.history_days(s, d).withColumn("nr", F.col("id") % 1000)
    return history.monotone(e, "user_id", ["created_at", "id"], "nr").join(history.monotone(e, "user_id", ["created_at", "id"], "created_at").withColumnRenamed("non_decreasing", "time_ordered"), "user_id")


@query
def avg_distribution(s, d):
    e = ad.history_days(s, d)
    total = e.agg(F.count("*").alias("total"))
    by = e.groupBy("query").agg(F.count("*").alias("n"), F.round(F.avg("cost"), 4).alias("avg_cost"), F.bool_and(F.col("cost") >= 0).alias("all_paid"), F.bool_or(F.col("cost") > 90).alias("any_high"))
    return by.join(F.broadcast(total)).select("query", "n", "avg_cost", "all_paid", "any_high", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 3).alias("percent"))


@query
def answer_validation(s, d):
    v = fm.validated(ad.table(s, d, "conversations"), "text")
    return v.select("conv_id", "turn", "first_line_len", "last_line_len", "total_chars", joined("issues", "; ").alias("issues"), "valid")


@query
def context_text(s, d):
    """The context of each source: its documents as chunks and videos. What a context shows is ranked first, so that no source's rows are gathered whole."""
    c = ad.chunks(s, d).withColumn("query_id", F.col("video_id"))
    fields = ("chunk_id", "video_id", "part_no", "video_title", "collection", "short_title", "text_preview")
    first = c.withColumn("nr", F.row_number().over(W.partitionBy("query_id").orderBy("chunk_id"))).where("nr <= 5")
    own = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("chunks"))
    titles = c.where("short_title IS NOT NULL").select("query_id", "short_title").distinct()
    titles = titles.withColumn("nr", F.row_number().over(W.partitionBy("query_id").orderBy("short_title"))).where("nr <= 12")
    own = own.join(titles.groupBy("query_id").agg(F.array_sort(F.collect_list("short_title")).alias("nodes")), "query_id", "left").withColumn("nodes", F.coalesce("nodes", F.expr("cast(array() as array<string>)")))
    text = fm.context_text(F.col("nodes"), F.expr("cast(array() as array<string>)"), F.slice("nodes", 2, 2), F.slice("nodes", 4, 9), F.col("chunks"), F.col("chunks"))
    return own.select(F.col("query_id").alias("source"), text.alias("context"))


@query
def prompt_build(s, d):
    docs = ad.table(s, d, "documents").select("doc_id", F.col("text").alias("q"), classify.complexity(F.col("text")).alias("complexity"))
    return docs.select("doc_id", fm.prompt(F.col("q"), F.col("complexity"), F.concat(F.lit("related_nodes: ["), F.col("doc_id").cast("string"), F.lit("]"))).alias("prompt"))


@query
def url_build_parse(s, d):
    p = ad.table(s, d, "pages")
    page = F.try_parse_url("url", F.lit("QUERY"), F.lit("page"))
    built = fm.video_url(F.col("page_id").cast("string"), F.col("page_id") % 5 + 1)
    checks = fm.answer_checks(F.concat(F.lit("see <en> P1: x\n    "), built))
    return p.select("page_id", page.alias("page"), built.alias("built"), F.try_parse_url(built, F.lit("QUERY"), F.lit("p")).alias("part"), *[c.alias(n) for n, c in checks.items()])


@query
def json_roundtrip(s, d):
    e = ad.table(s, d, "events")
    k = F.from_json("props", "k bigint").getField("k")
    return e.select("event_id", k.alias("k"), F.from_json(F.to_json(F.struct(k.alias("k"))), "k bigint").getField("k").alias("again"))


@query
def json_fields(s, d):
    """The fields of the events' properties with their types, found from the data."""
    return semi.fields(ad.table(s, d, "events"), "props")


@query
def json_typed(s, d):
    """The events with a typed column for each field that their properties have. Every tenth row's text is cut to show what malformed rows become."""
    e = ad.table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 5)).otherwise(F.col("props")).alias("props"))
    return semi.typed(e, "props", [("k", "bigint")]).select("event_id", "malformed", tx.or_else(F.col("k"), -1).alias("k"))


@query
def session_ready(s, d):
    """Which customers' sessions could ask: a key (blank for those in debt) and a grade (none in one segment)."""
    c = ad.table(s, d, "customer")
    key = F.when(F.col("c_acctbal") < 0, F.lit("  ")).otherwise(F.col("c_name"))
    return c.select("c_custkey", catalog.ready(key, F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))).alias("ready"))


@query
def own_month_cost(s, d):
    """A month's cost through the view of some learners, who see nobody else's rows."""
    own = history.Own(ad.users(s, d).where("grade = 'BUILDING'"), {"query_history": ad.history_quarters(s, d), "users": ad.users(s, d)})
    return own.month_cost(MONTH)


@query
def stored_lookup(s, d):
    """The stored history of each 50th user, by way of Bloom filters and sorted row groups."""
    path = own_folder(s)
    sinks.write_history(ad.history_quarters(s, d), path, 5000)
    last = ad.history_quarters(s, d).agg(F.max("user_id")).first()[0] or 0
    found = sinks.lookup_history(s, path, list(range(0, last + 1, 50)))
    return found.groupBy("user_id").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("month").alias("last_month"))


@query
def user_export(s, d):
    """One learner's rows of three tables as one document, read back: number of rows and their ids by table."""
    t = {"query_history": ad.history_quarters(s, d), "users": ad.users(s, d), "user_profile": ad.profiles(s, d)}
    out = sinks.export_user(s, t, 7)
    parts = F.map_entries(F.from_json("document", "map<string, struct<n: bigint, rows: array<string>>>"))
    ids = F.array_sort(F.transform("p.value.rows", lambda r: F.coalesce(F.get_json_object(r, "$.id"), F.get_json_object(r, "$.user_id")).cast("long")))
    return out.select("user_id", "total", F.explode(parts).alias("p")).select("user_id", "total", F.col("p.key").alias("name"), F.col("p.value.n").alias("n"), joined(F.transform(ids, lambda x: x.cast("string"))).alias("ids"))


@query
def user_scope(s, d):
    """The history that some learners' own session may read: cost by learner."""
    own = history.visible(ad.history_quarters(s, d), ad.users(s, d).where("grade = 'BUILDING'"))
    return own.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 2).alias("cost"), F.max(history.stamp_text(F.col("created_at"))).alias("last"))


@query
def id_format(s, d):
    """What customers' names are as ids and as commands, some written as anonymous ids and reserved words."""
    key, name = F.col("c_custkey"), F.col("c_name")
    words = F.array(*map(F.lit, ["  exit ", "profile", "cost", "   ", "q"]))
    x = F.when(key % 4 == 0, F.concat(F.lit("anon_"), F.substring(F.md5(F.encode(name, "UTF-8")), 1, 16))).when(key % 4 == 1, F.concat(F.lit("anon_"), name)).when(key % 4 == 2, F.get(words, (key % 5).cast("int"))).otherwise(name)
    return ad.table(s, d, "customer").select("c_custkey", x.alias("x")).select("c_custkey", catalog.anonymous_id(F.col("x")).alias("anonymous"), catalog.command(F.col("x")).alias("command"))


@query
def history_append(s, d):
    e = ad.history_days(s, d)
    nodes = F.array(F.col("query"), F.col("user_id").cast("string"))
    answers = e.select("user_id", "query", nodes.alias("related_nodes"), F.slice(nodes, 2, 1).alias("missing_prereqs"), F.repeat("diagnosis", 40).alias("response"), "cost", "created_at", "id")
    rows = history.history_rows(answers.drop("id"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.max("diagnosis_summary").alias("last_summary"), F.max(F.length("response_summary")).alias("longest"), F.round(F.sum("cost"), 2).alias("cost"))


@query
def text_replace(s, d):
    pages = ad.table(s, d, "pages").select("page_id", "url")
    out = sinks.replace_all(pages, "url", {"https://": "", "http://": "", ".example.": ".sample."})
    return out.withColumn("residue", F.contains("url", F.lit("example")))


@query
def encode_stub(s, d):
    e = vector.encode(ad.table(s, d, "documents").select("doc_id", "text"))
    return e.select("doc_id", F.size("vector").alias("dimension"), F.round(vx.norm(F.col("vector")), 4).alias("norm"))


@query
def encoded_neighbours(s, d):
    """The documents nearest to each benchmark text, by vectors of an encoder fitted on the documents, from a stored index of these."""
    docs = ad.table(s, d, "documents").select("doc_id", "text")
    fitted = encoder.fit(docs)
    # the index is written in several passes over the vectors
    made = written(encoder.encode(docs, fitted, "doc_id").select(F.col("doc_id").alias("pos"), F.col("vector").alias("embedding")))
    path = own_folder(s)
    vector_index.write_index(made, path)
    found = vector_index.search(encoder.encode(ad.queries(s, d), fitted, "query_id"), vector_index.read_index(s, path), 5)
    return found.select("query_id", F.col("pos").alias("doc_id"), "score", "rank")


@query
def minhash_pairs(s, d):
    return prep.minhash_pairs(ad.table(s, d, "documents").select("doc_id", "text"))


@query
def unicode_norm(s, d):
    n = prep.normalized(ad.table(s, d, "documents").select("doc_id", "text"), form="NFC")
    return n.select("doc_id", F.length("text").alias("n"), F.md5(F.encode("text", "UTF-8")).alias("md5"))


FIXES = {"teh": "the", "###": "", "!!": "!", "ss": "ß"}


@query
def typo_fix(s, d):
    docs = ad.table(s, d, "documents")
    fixed = prep.corrected(F.col("text"), FIXES)
    return docs.select("doc_id", F.length(fixed).alias("n"), F.md5(F.encode(fixed, "UTF-8")).alias("md5"))


@query
def misspelt_words(s, d):
    """Rare words of the documents with the known word that they are probably meant for."""
    return spelling.corrections(ad.table(s, d, "documents").select("text"))


@query
def prerequisite_graph(s, d):
    """The graph of the documents' tags: prerequisites, cycles as components, levels."""
    tags_of = ad.chunks(s, d).select(F.col("chunk_id").alias("doc_id"), F.concat("topics", "patterns").alias("tags"))
    return graph_build.build(tags_of).select("node", "n", "component", "level", joined("prerequisites").alias("prerequisites"))


@query
def chunking(s, d):
    return prep.chunk(ad.table(s, d, "documents").select("doc_id", "text")).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.md5(F.encode("chunk_text", "UTF-8")).alias("md5"))


@query
def unsupported_nodes(s, d):
    used = ad.table(s, d, "lineitem").where("l_quantity >= 45").select(F.col("l_partkey").alias("node_id"))
    return graph.unsupported(ad.graph_nodes(s, d).select("node_id", "category"), used)


@query
def unique_keys(s, d):
    return catalog.duplicates(ad.table(s, d, "lineitem"), ["l_orderkey", "l_partkey"])


SYSTEM = "You explain briefly. " * 20


@query
def llm_reply_cost(s, d):
    """Messages, the stub client's replies, and their cost."""
    docs = ad.table(s, d, "documents").select(F.col("doc_id").alias("query_id"), F.lit("").alias("static_text"), F.lit("").alias("recent_text"), F.col("text").alias("prompt"))
    replies = cost.call(fm.messages(docs, SYSTEM)).withColumn("provider", F.lit("p1")).withColumn("cache_created_tokens", F.lit(0))
    return cost.cost(replies, cost.providers(s)).select("query_id", "content", "input_tokens", "output_tokens", "cache_hit_tokens", "cost")


@query
def constraint_report(s, d):
    """Broken keys and references of the application's tables, by the schema registry."""
    # a profile for each order breaks its key, parts that no customer has break the reference
    profile = ad.table(s, d, "orders").select(F.col("o_custkey").alias("user_id"))
    asked = ad.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("user_id"))
    t = {"users": ad.users(s, d), "user_profile": profile, "query_history": asked}
    return catalog.check_constraints(t)


@query
def signal_tags(s, d):
    """Tags of documents by signal words, as a stand-in for a model's tagging."""
    signals = files.literal_rows(s, [("insult", "idiot"), ("insult", "moron"), ("licence", "license"), ("licence", "License"), ("secret", "token")], "tag string, signal string")
    tagged = prep.tag(ad.table(s, d, "documents").select("doc_id", "text"), signals)
    return tagged.select("doc_id", joined("tags").alias("tags"))
