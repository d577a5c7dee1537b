"""Queries of the page-view, n-gram, graph, tweet, dispatch, metric and media workloads, with their SQL."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from millrace.functions import qr, text
from millrace.operators import alarms, dispatch, graph, media, ngrams, pageviews, tweets
from millrace.operators.changes import current_rows
from millrace.session import scratch_folder, spread
from millrace.sources.tables import as_json, read_pageviews, table, write_pageviews
from millrace.streaming import matching

BANNED = ("broken", "stale", "noisy")
RULES = (alarms.Rule("avg-high", "avg", "1 day", True, 10.0), alarms.Rule("avg-low", "avg", "1 day", False, 9.9, 2, -1), alarms.Rule("max-high", "max", "1 day", True, 60.0), alarms.Rule("max-low", "max", "1 day", False, 90.0, 3, -1))


def word_count(spark, root):
    return ngrams.word_count(table(spark, root, "documents"))


def _views(spark, root):
    return pageviews.clean_views(pageviews.note_lines(table(spark, root, "documents")))


def pageview_clean(spark, root):
    return _views(spark, root)


def pageview_files(spark, root):
    """Page views by way of hourly gzip files, the day from a file's name."""
    folder = scratch_folder(spark, "pageviews")
    write_pageviews(pageviews.note_lines(table(spark, root, "documents")), folder, "201803")
    return pageviews.clean_views(read_pageviews(spark, folder))


def namespace_names(spark, root):
    """Prefixes from documents of namespaces, one a nation."""
    entry = lambda k, n: F.struct(F.lit(k).alias("k"), F.create_map(F.lit("*"), n).alias("v"))
    names = F.map_from_entries(F.array(entry("0", F.lit("")), entry("1", F.concat(F.col("n_name"), F.lit(" talk"))), entry("2", F.col("n_name"))))
    doc = F.to_json(F.struct(F.struct(names.alias("namespaces")).alias("query"))).alias("value")
    return pageviews.namespace_prefixes(table(spark, root, "nation").select(doc))


def order_prices(spark, root):
    """Prices as text of two decimals."""
    return table(spark, root, "orders").select("o_orderkey", text.two_places(F.col("o_totalprice")).alias("price"))


def title_counts(spark, root):
    return pageviews.ordered_counts(_views(spark, root))


def daily_vector_30(spark, root):
    return pageviews.daily_vectors(_views(spark, root), more_than=1_000)


def _letter_ngrams(spark, root):
    return ngrams.ngram_counts(table(spark, root, "documents"), text.letters_only)


def ngram_count(spark, root):
    return _letter_ngrams(spark, root)


def ngram_count_wiki(spark, root):
    return ngrams.ngram_counts(table(spark, root, "documents"), text.clean_wiki_text)


def _double_prob(df):
    return df.withColumn("prob", F.col("prob").cast("double"))


def next_word_topn(spark, root):
    return _double_prob(ngrams.next_words(_letter_ngrams(spark, root)))


def phrase_completion(spark, root):
    return _double_prob(ngrams.phrase_completions(_letter_ngrams(spark, root)))


def ref_texts(spark, root):
    found = F.explode(F.regexp_extract_all("text", F.lit("<ref(.*?)>(.*?)</ref>"), F.lit(2))).alias("ref")
    return table(spark, root, "documents").select("doc_id", found).where("trim(ref) <> ''").groupBy("ref").agg(F.count(F.lit(1)).alias("n"))


def follower_topk(spark, root):
    return graph.follower_top(table(spark, root, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v")))


def follower_topk_sql(spark, root):
    return graph.follower_top_sql(table(spark, root, "lineitem").select(F.col("l_orderkey").alias("u"), F.col("l_partkey").alias("v")))


def adjacency_lists(spark, root):
    return graph.adjacency(_supply(spark, root))


def _supply(spark, root):
    """Parts to suppliers, and suppliers to nations, so that nations are dangling."""
    p, s = table(spark, root, "lineitem"), table(spark, root, "supplier")
    name = lambda a, c: F.concat(F.lit(a), F.col(c).cast("string"))
    return p.select(name("P", "l_partkey").alias("u"), name("S", "l_suppkey").alias("v")).unionByName(s.select(name("S", "s_suppkey").alias("u"), name("N", "s_nationkey").alias("v")))


def degree_stats(spark, root):
    return graph.degrees(_supply(spark, root))


def dangling_nodes(spark, root):
    return graph.dangling(_supply(spark, root))


def source_nodes(spark, root):
    return graph.unfollowed(_supply(spark, root))


def pagerank(spark, root):
    return graph.pagerank(_supply(spark, root)).select("node", F.round("rank", 8).alias("rank"))


def hashtag_entries(spark, root):
    e = tweets.tag_rows(table(spark, root, "q2"))
    return e.groupBy("keyword").agg(F.count(F.lit(1)).alias("entries"), F.sum("n").alias("counted"), F.sum(F.size("users").cast("bigint")).alias("users"))


def hashtag_recommend(spark, root):
    """For the ten keywords with most rows, and the user of the first tweet."""
    q2 = table(spark, root, "q2")
    keys = q2.where("keyword IS NOT NULL").groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(tweets.MOST_KEYWORDS)
    user = table(spark, root, "q4").agg(F.min("uuid")).scalar()
    return tweets.recommend_hashtags(tweets.tag_rows(q2), keys, user, 50)


def _topic_tweets(spark, root):
    t = current_rows(table(spark, root, "q4"))
    return t.where("text IS NOT NULL").select(F.col("tweetid").alias("tweet"), "text", tweets.engagement().alias("impact"))


def topic_words(spark, root):
    return tweets.topic_words(_topic_tweets(spark, root), 20).select("word", F.round("score", 4).alias("score"))


def topic_tweets(spark, root):
    t = _topic_tweets(spark, root)
    return tweets.tweets_with(t, tweets.topic_words(t, 20), 50)


def _stored(spark, root):
    """Tweets of q4 as the store holds them; their time is that of the crawl."""
    t = current_rows(table(spark, root, "q4")).where("text IS NOT NULL AND uuid IS NOT NULL")
    shown = t.select("uuid", F.col("tweetid").alias("tid"), F.unix_seconds(F.col("crawled_at").cast("timestamp")).alias("ts"), F.lower("text").alias("tw"), F.col("text").alias("ct"), tweets.engagement().alias("impact"))
    return tweets.pack_arrays(shown)


USERS, TIMES = (1_000_000, 10_700_000), (1_520_000_000, 1_521_900_000)


def topic_range(spark, root):
    """Topic words of the tweets of some users within some time, from stored rows."""
    return tweets.stored_topics(_stored(spark, root), USERS, TIMES, 20).select("word", F.round("score", 4).alias("score"))


def stored_arrays(spark, root):
    """Stored rows taken apart again."""
    return tweets.unpack_arrays(_stored(spark, root)).select("uuid", "tid", "ts", "tw", "ct", F.col("nw").cast("bigint").alias("nw"), "impact")


def json_tweets(spark, root):
    t = current_rows(table(spark, root, "q4"))
    return as_json(t.select("tweetid", "uuid", "text", "favorite_count"))


def censor_words(spark, root):
    t = current_rows(table(spark, root, "q4")).where("text IS NOT NULL").select(F.col("tweetid").alias("tweet"), "text")
    return tweets.censored(t, BANNED)


def tweet_range_topn(spark, root):
    return tweets.range_top(current_rows(table(spark, root, "q4")), 1_000_000, 10_500_000, 100)


def match_score_topk(spark, root):
    c, s = table(spark, root, "customer"), table(spark, root, "supplier")
    side = lambda key: (F.pmod(F.col(key), F.lit(100)) / 100).cast("double")
    requests = c.select(F.col("c_custkey").alias("request"), F.col("c_nationkey").alias("area"), side("c_custkey").alias("lat"), F.lit(0.0).alias("lon"), F.when(F.col("c_custkey") % 3 == 0, "N").when(F.col("c_custkey") % 3 == 1, "F").otherwise("M").alias("preference"))
    drivers = s.select(F.col("s_suppkey").alias("driver"), F.col("s_nationkey").alias("area"), side("s_suppkey").alias("driver_lat"), F.lit(0.0).alias("driver_lon"), F.when(F.col("s_suppkey") % 2 == 0, "F").otherwise("M").alias("gender"), (F.col("s_suppkey") % 5 + 1).cast("double").alias("rating"), (F.col("s_suppkey") % 150).cast("double").alias("salary"))
    return dispatch.best_drivers(requests, drivers, "area").select("request", "driver", F.round("score", 6).alias("score"))


def partition_route(spark, root):
    return dispatch.route(table(spark, root, "driver_messages")).groupBy("topic", "partition").agg(F.count(F.lit(1)).alias("messages"))


def dead_letters(spark, root):
    return dispatch.dead_letters(table(spark, root, "driver_messages")).select("arrival_id", "msg_type", "block_id")


def dispatch_replay(spark, root):
    return dispatch.replay(table(spark, root, "driver_messages"))


def safe_int(spark, root):
    a = table(spark, root, "q4_actions").where("op = 'set'")
    return a.select("delivery_id", text.safe_int(text.percent_decode(F.col("payload"))).alias("number"))


def percent_decode(spark, root):
    return table(spark, root, "q4_actions").where("payload IS NOT NULL").select("delivery_id", text.percent_decode(F.col("payload")).alias("decoded"))


def java_hash(spark, root):
    u = table(spark, root, "q4_actions").where("uuid IS NOT NULL").select("uuid").distinct()
    return u.select("uuid", text.java_hash(F.col("uuid")).alias("hash"), text.shard(F.col("uuid")).alias("shard"))


def json_props(spark, root):
    e = table(spark, root, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("k_sum"), F.max("k").alias("k_max"))


def metric_alarm(spark, root):
    e = table(spark, root, "events").select("ts", F.col("event_type").alias("name"), "value")
    stats = alarms.period_statistics(e, "1 day")
    out = None
    for r in RULES:
        a = alarms.alarms(stats, r)
        out = a if out is None else out.unionByName(a)
    return out.select("name", F.date_format("start", "yyyy-MM-dd").alias("day"), "rule", "change")


def _captions(spark, root):
    """Caption documents, however their source is spelt, and their labels between commas of either kind."""
    d = table(spark, root, "documents").where("lower(trim(source)) = 'label_captions' AND text IS NOT NULL")
    return d.select("doc_id", F.split("text", ", |、", -1).alias("names"))


def label_index(spark, root):
    return media.label_index(_captions(spark, root), "doc_id", F.col("names"))


def label_documents(spark, root):
    c = _captions(spark, root).select(F.concat(F.lit("captions/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("key"), "names")
    return media.label_documents(c, "key", F.col("names")).select("id", "type", F.col("fields.key").alias("key"), F.size("fields.labels").alias("labels"), F.element_at("fields.labels", 1).alias("first_label"))


def frame_sample(spark, root):
    e = table(spark, root, "events").select("user_id", "ts", "event_id", "event_type")
    f = media.sample_frames(e, "user_id", "ts", "1 day")
    return f.select("user_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_id", "event_type")


def qr_roundtrip(spark, root):
    c = spread(table(spark, root, "customer").select("c_custkey", "c_name"))
    return c.select("c_custkey", qr.qr_decode(qr.qr_canvas("c_name")).alias("decoded"))


def qr_codes(spark, root):
    return spread(table(spark, root, "customer").select("c_custkey", "c_name")).select("c_custkey", qr.qr_encode("c_name").alias("code"))


PARTS = 64  # files a trigger


def _stream(spark, root, name):
    """A Parquet table as a file stream: a folder of parts, or one file in ``root``."""
    path = f"{root}/{name}.parquet"
    reader = spark.readStream.schema(table(spark, root, name).schema).option("maxFilesPerTrigger", PARTS)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(root)


def _base(spark):
    return scratch_folder(spark, "stream")


def _run(spark, df, run=matching.run_to_table, base=None):
    """A stream run to its end into the session's shared folder."""
    base = base or _base(spark)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run(df, f"{base}/out", f"{base}/state")
    finally:
        if old is not None:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def stream_matches(spark, root):
    """Messages in order of arrival: a table of more files than one trigger takes is fed in ranges of it, a run each."""
    messages = table(spark, root, "driver_messages")
    n = -(-len(messages.inputFiles()) // PARTS)
    if n > 1:
        base, place = _base(spark), F.col("arrival_id")
        cuts = [int(c) for c in messages.approxQuantile("arrival_id", [k / n for k in range(1, n)], 0.001)]
        messages.limit(0).write.parquet(f"{base}/in")
        for low, high in zip([None, *cuts], [*cuts, None]):
            some = messages if low is None else messages.where(place >= low)
            some = some if high is None else some.where(place < high)
            some.coalesce(PARTS - 1).write.mode("append").parquet(f"{base}/in")
            out = _run(spark, matching.match_stream(spark.readStream.schema(messages.schema).option("maxFilesPerTrigger", PARTS).parquet(f"{base}/in")), base=base)
        return out
    return _run(spark, matching.match_stream(_stream(spark, root, "driver_messages")))


def stream_window_counts(spark, root):
    counts = matching.window_counts(_stream(spark, root, "events"), "ts", "event_type", "value", "1 day", late=None)
    return _run(spark, counts, matching.run_whole).withColumn("total", F.round("total", 4))


QUERIES = {f.__name__: f for f in (
    word_count, pageview_clean, pageview_files, namespace_names, order_prices, title_counts, daily_vector_30, ngram_count, ngram_count_wiki, next_word_topn, phrase_completion, ref_texts, follower_topk, follower_topk_sql, adjacency_lists, degree_stats, dangling_nodes, source_nodes, pagerank,
    hashtag_entries, hashtag_recommend, topic_words, topic_tweets, topic_range, stored_arrays, json_tweets, censor_words, tweet_range_topn, match_score_topk, partition_route, dead_letters, dispatch_replay, safe_int, percent_decode, java_hash, json_props,
    metric_alarm, label_index, label_documents, frame_sample, qr_roundtrip, qr_codes, stream_matches, stream_window_counts,
)}

_VIEWS = f"""
l AS (SELECT CAST(day(written_at) AS INTEGER) AS day, string_split(rtrim(unnest(string_split_regex(text, '\\r\\n|\\r|\\n')), ' '), ' ') AS p FROM documents),
t AS (SELECT url_decode(p[2]) AS title, day, CASE WHEN regexp_full_match(p[3], '[+-]?[0-9]+') THEN coalesce(TRY_CAST(p[3] AS INTEGER), 0) ELSE 0 END AS views FROM l WHERE len(p) = 4 AND p[1] IN ('en', 'en.m')),
v AS (SELECT * FROM t WHERE title <> ''
  AND NOT regexp_matches(title, '(?i)^({"|".join(pageviews.NAMESPACES)})(_talk)?:') AND NOT regexp_matches(title, '^[a-z]') AND NOT lower(title) LIKE '%\\_(disambiguation)' ESCAPE '\\'
  AND NOT regexp_matches(title, '(?i)\\.({"|".join(pageviews.EXTENSIONS)})$') AND title NOT IN ('404.php', 'Main_Page', '-'))"""

_GRAMS = """
li AS (SELECT trim(regexp_replace(lower(unnest(string_split_regex(text, '\\r\\n|\\r|\\n'))), '[^a-z]+', ' ', 'g')) AS line FROM documents),
w AS (SELECT string_split(line, ' ') AS w FROM li WHERE line <> ''),
g AS (SELECT array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT w, unnest(range(1, least(5, len(w)) + 1)) AS n FROM w))),
counts AS (SELECT phrase, count(*) AS n FROM g GROUP BY phrase HAVING count(*) > 2)"""

_SUPPLY = "edges AS (SELECT DISTINCT 'P' || l_partkey AS u, 'S' || l_suppkey AS v FROM lineitem UNION SELECT DISTINCT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier)"

_TWEETS = """
base AS (SELECT * FROM q4 WHERE tweetid IS NOT NULL QUALIFY row_number() OVER (PARTITION BY tweetid ORDER BY crawled_at DESC NULLS LAST, favorite_count DESC NULLS LAST, retweet_count DESC NULLS LAST, text DESC NULLS LAST, username DESC NULLS LAST, uuid DESC NULLS LAST, source DESC NULLS LAST) = 1),
tw AS (SELECT tweetid AS tweet, text, coalesce(favorite_count, 0) + coalesce(retweet_count, 0) AS impact FROM base WHERE text IS NOT NULL)"""

_TOPICS = f"""{_TWEETS},
wl AS (SELECT tweet, impact, list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '') AS w FROM tw),
tot AS (SELECT count(*) AS n FROM wl WHERE len(w) > 0),
wo AS (SELECT tweet, impact, len(w) AS nw, unnest(w) AS word FROM wl),
sc AS (SELECT word, sum(ln(1 + impact) / nw) AS s, count(DISTINCT tweet) AS df FROM wo GROUP BY word),
top AS (SELECT word, s * ln((SELECT n FROM tot)::DOUBLE / df) AS score FROM sc ORDER BY score DESC, word LIMIT 20)"""


def _pagerank_sql(iterations: int = 10) -> str:
    parts = [_SUPPLY, "outd AS (SELECT u, count(*) AS d FROM edges GROUP BY u)", "nodes AS (SELECT u AS node FROM edges UNION SELECT v FROM edges)", "cnt AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "r0 AS (SELECT node, 1.0 / n AS rank FROM nodes, cnt)"]
    for k in range(1, iterations + 1):
        p = f"r{k - 1}"
        parts.append(f"g{k} AS MATERIALIZED (SELECT e.v AS node, sum(r.rank / o.d) AS x FROM edges e JOIN {p} r ON r.node = e.u JOIN outd o ON o.u = e.u GROUP BY e.v)")
        parts.append(f"d{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS x FROM {p} WHERE node NOT IN (SELECT u FROM outd))")
        parts.append(f"r{k} AS MATERIALIZED (SELECT n.node, 0.15 / c.n + 0.85 * (coalesce(g.x, 0) + d.x / c.n) AS rank FROM nodes n CROSS JOIN cnt c CROSS JOIN d{k} d LEFT JOIN g{k} g ON g.node = n.node)")
    return f"WITH {', '.join(parts)} SELECT node, round(rank, 8) AS rank FROM r{iterations}"


_ALARM = "SELECT name, strftime(start, '%Y-%m-%d') AS day, '{name}' AS rule, CAST({change} AS INTEGER) AS change FROM (SELECT *, count(*) OVER w AS k, min(CASE WHEN {stat} {op} {thr} THEN 1 ELSE 0 END) OVER w AS ok FROM st WINDOW w AS (PARTITION BY name ORDER BY start ROWS BETWEEN {before} PRECEDING AND CURRENT ROW)) WHERE ok = 1 AND k = {n}"

_LISTS = """
z AS (SELECT row_no, keyword, string_split(regexp_replace(hashtags, ',+$', ''), ',') AS t, string_split(regexp_replace(counts, ',+$', ''), ',') AS c, coalesce(string_split(users, ':'), []) AS u FROM q2),
e AS (SELECT row_no, keyword, t[i] AS tag, TRY_CAST(c[i] AS BIGINT) AS n, CASE WHEN coalesce(u[i], '') <> '' THEN string_split(u[i], ',') ELSE [] END AS users FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM z WHERE len(t) = len(c)))"""

_CAPTIONS = "captions AS (SELECT doc_id, string_split_regex(text, ', |、') AS names FROM documents WHERE lower(trim(source)) = 'label_captions' AND text IS NOT NULL)"
_RANGE = f"WHERE text IS NOT NULL AND uuid BETWEEN {USERS[0]} AND {USERS[1]} AND floor(epoch(crawled_at)) BETWEEN {TIMES[0]} AND {TIMES[1]}"

ORACLE = {
    "word_count": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word",
    "pageview_clean": f"WITH {_VIEWS} SELECT title, day, views FROM v",
    "title_counts": f"WITH {_VIEWS} SELECT title, CAST(sum(views) AS BIGINT) AS views FROM v GROUP BY title",
    "daily_vector_30": f"WITH {_VIEWS}, s AS (SELECT title, day, sum(views) AS n FROM v WHERE day BETWEEN 1 AND 30 GROUP BY title, day), m AS (SELECT title, CAST(sum(n) AS BIGINT) AS total, map(list(day), list(n)) AS m FROM s GROUP BY title HAVING sum(n) > 1000) SELECT total, title, list_transform(range(1, 31), lambda d: CAST(coalesce(m[CAST(d AS INTEGER)], 0) AS BIGINT)) AS daily FROM m",
    "ngram_count": f"WITH {_GRAMS} SELECT phrase, n FROM counts",
    "next_word_topn": f"WITH {_GRAMS}, x AS (SELECT array_to_string(list_slice(string_split(phrase, ' '), 1, len(string_split(phrase, ' ')) - 1), ' ') AS prefix, string_split(phrase, ' ')[-1] AS suffix, n FROM counts WHERE contains(phrase, ' ')) SELECT x.prefix, x.suffix, CAST(CAST(x.n AS FLOAT) / CAST(c.n AS FLOAT) AS DOUBLE) AS prob FROM x JOIN counts c ON c.phrase = x.prefix QUALIFY row_number() OVER (PARTITION BY x.prefix ORDER BY x.n DESC, x.suffix) <= 5",
    "phrase_completion": f"""WITH {_GRAMS}, x AS (SELECT w, n, unnest(range(1, len(w))) AS i FROM (SELECT string_split(phrase, ' ') AS w, n FROM counts)),
s AS (SELECT array_to_string(list_slice(w, 1, i), ' ') AS prefix, array_to_string(list_slice(w, i + 1, len(w)), ' ') AS suffix, CAST(len(w) - i AS INTEGER) AS suffix_len, n FROM x),
p AS (SELECT s.*, CAST(s.n AS FLOAT) / CAST(c.n AS FLOAT) AS prob FROM s JOIN counts c ON c.phrase = s.prefix),
o AS (SELECT * FROM p WHERE prob > CAST(CASE suffix_len WHEN 1 THEN 0.05 WHEN 2 THEN 0.03 WHEN 3 THEN 0.01 WHEN 4 THEN 0.005 END AS FLOAT))
SELECT prefix, suffix, suffix_len, CAST(prob AS DOUBLE) AS prob FROM o QUALIFY row_number() OVER (PARTITION BY prefix, suffix_len ORDER BY n DESC, suffix) <= CASE suffix_len WHEN 1 THEN 3 WHEN 4 THEN 1 ELSE 2 END""",
    "ref_texts": "SELECT ref, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '<ref(.*?)>(.*?)</ref>', 2)) AS ref FROM documents) WHERE trim(ref) <> '' GROUP BY ref",
    "follower_topk": "SELECT l_partkey AS followee, count(l_orderkey) AS count FROM lineitem GROUP BY l_partkey ORDER BY count DESC, followee LIMIT 100",
    "degree_stats": f"WITH {_SUPPLY} SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT u AS node, 1 AS o, 0 AS i FROM edges UNION ALL SELECT v, 0, 1 FROM edges) GROUP BY node",
    "dangling_nodes": f"WITH {_SUPPLY} SELECT v AS node FROM edges EXCEPT SELECT u FROM edges",
    "source_nodes": f"WITH {_SUPPLY} SELECT u AS node FROM edges EXCEPT SELECT v FROM edges",
    "pagerank": _pagerank_sql(),
    "hashtag_entries": f"WITH {_LISTS} SELECT keyword, count(*) AS entries, CAST(sum(n) AS BIGINT) AS counted, CAST(sum(len(users)) AS BIGINT) AS users FROM e GROUP BY keyword",
    "hashtag_recommend": f"WITH {_LISTS}, keys AS (SELECT keyword FROM q2 WHERE keyword IS NOT NULL GROUP BY keyword ORDER BY count(*) DESC, keyword LIMIT 10), who AS (SELECT CAST(min(uuid) AS VARCHAR) AS id FROM q4) SELECT '#' || tag AS hashtag, CAST(n + CASE WHEN list_contains(users, who.id) THEN 1 ELSE 0 END AS BIGINT) AS score FROM e, who WHERE keyword IN (SELECT keyword FROM keys) AND n IS NOT NULL AND tag <> '' ORDER BY score DESC, hashtag LIMIT 50",
    "topic_words": f"WITH {_TOPICS} SELECT word, round(score, 4) AS score FROM top",
    "topic_tweets": f"WITH {_TOPICS} SELECT DISTINCT tweet, impact FROM wo WHERE word IN (SELECT word FROM top) ORDER BY impact DESC, CAST(tweet AS VARCHAR) DESC LIMIT 50",
    "censor_words": f"WITH {_TWEETS} SELECT tweet, array_to_string(list_transform(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f]+'), lambda x: x <> ''), lambda x: CASE WHEN lower(x) IN {BANNED} THEN left(x, 1) || repeat('*', length(x) - 2) || right(x, 1) ELSE x END), ' ') AS text FROM tw",
    "tweet_range_topn": f"WITH {_TWEETS} SELECT tweetid, uuid, coalesce(favorite_count, 0) + coalesce(retweet_count, 0) AS engagement FROM base WHERE uuid BETWEEN 1000000 AND 10500000 ORDER BY engagement DESC, tweetid LIMIT 100",
    "match_score_topk": """WITH r AS (SELECT c_custkey AS request, c_nationkey AS area, (c_custkey % 100) / 100.0::DOUBLE AS lat, CASE c_custkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'F' ELSE 'M' END AS pref FROM customer),
d AS (SELECT s_suppkey AS driver, s_nationkey AS area, (s_suppkey % 100) / 100.0::DOUBLE AS lat, CASE WHEN s_suppkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender, (s_suppkey % 5 + 1)::DOUBLE AS rating, (s_suppkey % 150)::DOUBLE AS salary FROM supplier),
p AS (SELECT request, driver, salary, 0.4::DOUBLE * exp(-sqrt(power(r.lat - d.lat, 2))) + 0.1::DOUBLE * CASE WHEN pref = 'N' OR pref = gender THEN 1 ELSE 0 END + 0.3::DOUBLE * rating / 5 + 0.2::DOUBLE * (1 - salary / 100) AS score FROM r JOIN d ON r.area = d.area)
SELECT request, driver, round(score, 6) AS score FROM p QUALIFY row_number() OVER (PARTITION BY request ORDER BY salary < 100 DESC, score DESC, driver) = 1""",
    "partition_route": "SELECT CASE WHEN msg_type = 'DRIVER_LOCATION' THEN 'driver-locations' ELSE 'events' END AS topic, CAST(block_id % 5 AS INTEGER) AS partition, count(*) AS messages FROM driver_messages WHERE block_id IS NOT NULL AND msg_type IN ('DRIVER_LOCATION', 'LEAVING_BLOCK', 'ENTERING_BLOCK', 'RIDE_REQUEST', 'RIDE_COMPLETE') GROUP BY ALL",
    "dead_letters": "SELECT arrival_id, msg_type, block_id FROM driver_messages WHERE block_id IS NULL OR msg_type IS NULL OR msg_type NOT IN ('DRIVER_LOCATION', 'LEAVING_BLOCK', 'ENTERING_BLOCK', 'RIDE_REQUEST', 'RIDE_COMPLETE')",
    "safe_int": "SELECT delivery_id, CASE WHEN regexp_full_match(url_decode(payload), '[+-]?[0-9]+') THEN coalesce(TRY_CAST(url_decode(payload) AS INTEGER), 0) ELSE 0 END AS number FROM q4_actions WHERE op = 'set'",
    "percent_decode": "SELECT delivery_id, url_decode(payload) AS decoded FROM q4_actions WHERE payload IS NOT NULL",
    "java_hash": "WITH u AS (SELECT DISTINCT uuid FROM q4_actions WHERE uuid IS NOT NULL), h AS (SELECT uuid, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(uuid, ''), lambda x: ord(x)::BIGINT)), lambda a, b: (a * 31 + b) & 4294967295) AS h FROM u) SELECT uuid, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END % 7) AS INTEGER) AS shard FROM h",
    "json_props": "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS k_sum, max(k) AS k_max FROM (SELECT event_type, CAST(props ->> '$.k' AS INTEGER) AS k FROM events) GROUP BY event_type",
    "metric_alarm": "WITH st AS (SELECT event_type AS name, date_trunc('day', ts) AS start, avg(value) AS avg, max(value) AS max FROM events WHERE value IS NOT NULL GROUP BY ALL) " + " UNION ALL ".join(_ALARM.format(name=r.name, change=r.change, stat=r.statistic, op=">" if r.above else "<", thr=r.threshold, before=r.periods - 1, n=r.periods) for r in RULES),
    "label_index": f"WITH {_CAPTIONS} SELECT label, count(*) AS keys, min(doc_id) AS first_key, max(doc_id) AS last_key FROM (SELECT DISTINCT doc_id, unnest(names) AS label FROM captions) WHERE label <> '' GROUP BY label",
    "label_documents": f"WITH {_CAPTIONS} SELECT 'captions/' || doc_id AS id, 'add' AS type, 'captions/' || doc_id || '.jpg' AS key, CAST(len(names) AS INTEGER) AS labels, names[1] AS first_label FROM captions",
    "pageview_files": f"WITH {_VIEWS} SELECT title, day, views FROM v",
    "namespace_names": "SELECT DISTINCT unnest([replace(lower(n_name), ' ', '_') || ':', replace(lower(n_name), ' ', '_') || '_talk:']) AS prefix FROM nation",
    "order_prices": "SELECT o_orderkey, format('{:.2f}', o_totalprice) AS price FROM orders",
    "follower_topk_sql": "SELECT l_partkey AS followee, count(l_orderkey) AS count FROM lineitem GROUP BY l_partkey ORDER BY count DESC, followee LIMIT 100",
    "adjacency_lists": f"WITH {_SUPPLY} SELECT u AS node, list_sort(list(v)) AS follows FROM edges GROUP BY u",
    "json_tweets": f"WITH {_TWEETS} SELECT CAST(to_json({{'tweetid': tweetid, 'uuid': uuid, 'text': text, 'favorite_count': favorite_count}}) AS VARCHAR) AS value FROM base",
    "stored_arrays": f"WITH {_TWEETS} SELECT uuid, tweetid AS tid, CAST(floor(epoch(crawled_at)) AS BIGINT) AS ts, lower(text) AS tw, text AS ct, len(list_filter(string_split_regex(lower(text), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')) AS nw, coalesce(favorite_count, 0) + coalesce(retweet_count, 0) AS impact FROM base WHERE text IS NOT NULL AND uuid IS NOT NULL",
    "topic_range": f"WITH {_TOPICS.replace('WHERE text IS NOT NULL', _RANGE)} SELECT word, round(score, 4) AS score FROM top",
    "stream_window_counts": "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL",
    "frame_sample": "SELECT user_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_id, event_type FROM events WHERE ts IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id, event_type) = 1",
    "qr_roundtrip": "SELECT c_custkey, c_name AS decoded FROM customer",
}
