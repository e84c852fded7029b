"""Shared CTEs of the DuckDB checks."""

from __future__ import annotations

CTES: dict[str, str] = {}


def with_ctes(names: str, body: str) -> str:
    """``body`` after the named CTEs, in the order given."""
    parts = ",\n".join(f"{n} AS ({CTES[n]})" for n in names.split())
    return f"WITH {parts}\n{body}"


CTES["behaviors"] = """
SELECT event_id AS impression_id, user_id,
  CASE WHEN event_type = 'signup' THEN NULL
       ELSE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END AS article_id,
  ts AS impression_time, value AS read_time,
  CASE WHEN event_type = 'error' THEN NULL
       ELSE CAST((event_id * 37) % 101 AS DOUBLE) END AS scroll_percentage,
  CAST(NULL AS BIGINT) AS age, event_type AS device_type
FROM events"""
CTES["known"] = "SELECT * FROM behaviors WHERE article_id IS NOT NULL"
CTES["articles"] = """
SELECT e.vec_id AS article_id, CAST(e.label AS BIGINT) AS category, o.o_orderdate AS published_time,
  (e.vec_id % 2) = 0 AS premium
FROM embeddings e JOIN orders o ON o.o_orderkey = e.vec_id + 1"""
CTES["topics"] = """
SELECT vec_id AS article_id, CAST(label AS BIGINT) AS topic FROM embeddings
UNION ALL SELECT vec_id, 10 + vec_id % 7 FROM embeddings"""
CTES["big"] = """
SELECT l_orderkey * 10 + l_linenumber AS impression_id, o_custkey AS user_id, l_partkey AS article_id,
  o_orderdate AS impression_time, l_quantity AS read_time, l_discount * 1000 AS scroll_percentage
FROM orders JOIN lineitem ON l_orderkey = o_orderkey"""

# Interactions and their weighted scores, from either log.
CTES["inter"] = """
SELECT article_id, user_id, coalesce(product(read_time), 1.0) AS total_readtime, max(scroll_percentage) AS max_scroll
FROM known GROUP BY article_id, user_id"""
CTES["inter_big"] = """
SELECT article_id, user_id, coalesce(product(read_time), 1.0) AS total_readtime, max(scroll_percentage) AS max_scroll
FROM big GROUP BY article_id, user_id"""
CTES["s"] = "SELECT user_id, article_id, max_scroll + total_readtime AS v FROM inter"
CTES["s_big"] = "SELECT user_id, article_id, max_scroll * 0.1::DOUBLE + total_readtime AS v FROM inter_big"
CTES["s_bin"] = "SELECT user_id, article_id, 1.0::DOUBLE AS v FROM inter"


def unit(source: str, entity: str, key: str) -> str:
    return f"""
SELECT {entity} AS e, {key} AS f, v / sqrt(sum(v * v) OVER (PARTITION BY {entity})) AS x
FROM {source} WHERE v IS NOT NULL AND v <> 0"""


CTES["unit_u"] = unit("s", "user_id", "article_id")
CTES["unit_u_big"] = unit("s_big", "user_id", "article_id")
CTES["unit_u_bin"] = unit("s_bin", "user_id", "article_id")
CTES["unit_i"] = unit("s", "article_id", "user_id")
CTES["unit_i_big"] = unit("s_big", "article_id", "user_id")
CTES["unit_i_bin"] = unit("s_bin", "article_id", "user_id")
CTES["topic_rows"] = "SELECT DISTINCT article_id, topic, 1.0::DOUBLE AS v FROM topics"
CTES["unit_t"] = unit("topic_rows", "article_id", "topic")


def neighbours(source: str, k: int = 10) -> str:
    return f"""
SELECT entity, neighbor, sim, rk FROM (
  SELECT a AS entity, b AS neighbor, sim, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rk
  FROM (SELECT l.e AS a, r.e AS b, sum(l.x * r.x) AS sim FROM {source} l JOIN {source} r ON l.f = r.f AND l.e <> r.e
        GROUP BY l.e, r.e) p
  WHERE sim > 0) q
WHERE rk <= {k}"""


for _kind in ("u", "u_big", "u_bin", "i", "i_big", "i_bin", "t"):
    CTES[f"nb_{_kind}"] = neighbours(f"unit_{_kind}")


def top(scores: str, n: int = 5) -> str:
    """Top-n rows of a (user_id, article_id, score) source."""
    return f"""
SELECT user_id, article_id, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC NULLS LAST, article_id) AS INTEGER) AS rank
  FROM ({scores}) a) b
WHERE rank <= {n}"""


def user_cf_scores(kind: str, source: str, binary: bool = False, allow_read: bool = False) -> str:
    total = "CAST(count(*) AS DOUBLE)" if binary else "coalesce(sum(i.v), 0)"
    unread = "" if allow_read else f"""
  WHERE NOT EXISTS (SELECT 1 FROM {source} d WHERE d.user_id = c.user_id AND d.article_id = c.article_id)"""
    return f"""SELECT c.* FROM (
  SELECT nb.entity AS user_id, i.article_id, {total} AS score
  FROM nb_{kind} nb JOIN {source} i ON i.user_id = nb.neighbor GROUP BY nb.entity, i.article_id) c {unread}"""


def item_cf_scores(kind: str, source: str, allow_read: bool = False) -> str:
    unread = "" if allow_read else f"""
  WHERE NOT EXISTS (SELECT 1 FROM {source} d WHERE d.user_id = c.user_id AND d.article_id = c.article_id)"""
    return f"""SELECT c.* FROM (
  SELECT i.user_id, nb.neighbor AS article_id, sum(nb.sim) AS score
  FROM {source} i JOIN nb_{kind} nb ON i.article_id = nb.entity GROUP BY i.user_id, nb.neighbor) c {unread}"""


CTES["rec_u"] = top(user_cf_scores("u", "s"))
CTES["rec_u_big"] = top(user_cf_scores("u_big", "s_big"))
CTES["rec_u_bin"] = top(user_cf_scores("u_bin", "s_bin", binary=True))
CTES["rec_i"] = top(item_cf_scores("i", "s"))
CTES["rec_i_big"] = top(item_cf_scores("i_big", "s_big"))
CTES["rec_i_bin"] = top(item_cf_scores("i_bin", "s_bin"))

# Interaction score of every pair.
CTES["rolled"] = """
SELECT user_id, article_id, coalesce(sum(read_time), 0) AS read_time, max(scroll_percentage) AS scroll,
  max(impression_time) AS impression_time
FROM known GROUP BY user_id, article_id"""
CTES["engaged"] = "SELECT *, ln(read_time + 1) * scroll AS engagement FROM rolled"
CTES["ages"] = "SELECT article_id, CAST(epoch_us(published_time) AS DOUBLE) AS age FROM articles"
CTES["scored"] = """
SELECT e.user_id, e.article_id, e.impression_time,
  (e.engagement - m.lo) / nullif(m.hi - m.lo, 0) * 0.8::DOUBLE + (a.age - n.lo) / nullif(n.hi - n.lo, 0) * 0.2::DOUBLE AS score
FROM engaged e
CROSS JOIN (SELECT min(engagement) AS lo, max(engagement) AS hi FROM engaged) m
CROSS JOIN (SELECT min(age) AS lo, max(age) AS hi FROM ages) n
LEFT JOIN ages a ON a.article_id = e.article_id"""
SCORED = "behaviors known articles rolled engaged ages scored"

# Bias model.
CTES["cells"] = """
SELECT user_id, article_id, coalesce(avg(score), 0) AS rating FROM scored GROUP BY user_id, article_id"""
CTES["mu"] = "SELECT coalesce(avg(rating), 0) AS mu FROM cells WHERE rating <> 0"
CTES["b_u"] = """
SELECT user_id, coalesce(avg(rating - mu) FILTER (WHERE rating <> 0), 0) AS user_bias
FROM cells CROSS JOIN mu GROUP BY user_id"""
CTES["b_i"] = """
SELECT article_id, coalesce(avg(rating - mu - user_bias) FILTER (WHERE rating <> 0), 0) AS item_bias
FROM cells JOIN b_u USING (user_id) CROSS JOIN mu GROUP BY article_id"""
BIAS = f"{SCORED} cells mu b_u b_i"
CTES["rec_bias"] = """
SELECT user_id, article_id, score, rank FROM (
  SELECT u.user_id, i.article_id, mu + user_bias + item_bias AS score,
    CAST(row_number() OVER (PARTITION BY u.user_id ORDER BY round(item_bias, 9) DESC, i.article_id) AS INTEGER) AS rank
  FROM b_u u CROSS JOIN b_i i CROSS JOIN mu
  WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.user_id = u.user_id AND c.article_id = i.article_id AND c.rating <> 0)) q
WHERE rank <= 5"""

# Splits.
HASH = "((({key}) % 2147483648) * 2654435761) % 4294967296 / 4294967296.0::DOUBLE"


def hash_of(key: str) -> str:
    return HASH.format(key=key)


CTES["hash_train"] = f"SELECT * FROM known WHERE {hash_of('impression_id')} >= 0.3::DOUBLE"
CTES["hash_test"] = f"SELECT * FROM known WHERE {hash_of('impression_id')} < 0.3::DOUBLE"
CTES["by_time"] = """
SELECT *, row_number() OVER (ORDER BY impression_time, impression_id) AS nth, count(*) OVER () AS n FROM known"""
CTES["time_test"] = "SELECT * FROM by_time WHERE nth <= CAST(floor(n * 0.3::DOUBLE) AS BIGINT)"
CTES["time_train"] = "SELECT * FROM by_time WHERE nth > CAST(floor(n * 0.3::DOUBLE) AS BIGINT)"


def popular(source: str, n: int = 5) -> str:
    return f"""
SELECT article_id, c, CAST(row_number() OVER (ORDER BY c DESC, article_id) AS INTEGER) AS rank
FROM (SELECT article_id, count(*) AS c FROM {source} GROUP BY article_id) p QUALIFY rank <= {n}"""


def popular_recs(source: str, n: int = 5) -> str:
    return f"""
SELECT u.user_id, p.article_id, CAST(p.c AS DOUBLE) AS score, p.rank
FROM (SELECT DISTINCT user_id FROM {source}) u CROSS JOIN ({popular(source, n)}) p"""


def user_metrics(rec: str, test: str, k: int = 5, users: str | None = None) -> str:
    """Per-user metrics of a recommendation source against a test source."""
    among = f"WHERE user_id IN (SELECT user_id FROM {users})" if users else ""
    return f"""
SELECT c.user_id, c.relevant, coalesce(h.returned, 0) AS returned, coalesce(h.hits, 0) AS hits,
  coalesce(h.hits, 0) / {k}.0::DOUBLE AS "precision",
  coalesce(h.hits, 0) / CAST(c.relevant AS DOUBLE) AS recall,
  CASE WHEN t.n > c.relevant THEN (coalesce(h.returned, 0) - coalesce(h.hits, 0)) / CAST(t.n - c.relevant AS DOUBLE) ELSE 0 END AS fpr,
  coalesce(h.gain, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {k} + 1) r(i) WHERE i <= c.relevant) AS ndcg,
  coalesce(h.psum, 0) / least(c.relevant, {k}) AS ap
FROM (SELECT user_id, count(DISTINCT article_id) AS relevant FROM {test} {among} GROUP BY user_id) c
CROSS JOIN (SELECT count(DISTINCT article_id) AS n FROM {test}) t
LEFT JOIN (
  SELECT user_id, count(*) AS returned, sum(hit) AS hits, sum(hit / log2(rank + 1)) AS gain, sum(hit * seen / rank) AS psum
  FROM (SELECT user_id, rank, CAST(hit AS DOUBLE) AS hit, sum(hit) OVER (PARTITION BY user_id ORDER BY rank) AS seen
        FROM (SELECT r.user_id, r.rank, CASE WHEN EXISTS (SELECT 1 FROM {test} x
                WHERE x.user_id = r.user_id AND x.article_id = r.article_id) THEN 1 ELSE 0 END AS hit
              FROM {rec} r WHERE r.rank <= {k}) y) z
  GROUP BY user_id) h ON h.user_id = c.user_id"""


def evaluated(rec: str, test: str, k: int = 5, users: str | None = None) -> str:
    return f"""
SELECT round(coalesce(avg("precision"), 0), 6) AS "precision", round(coalesce(avg(recall), 0), 6) AS recall,
  round(coalesce(avg(fpr), 0), 6) AS fpr, count(*) AS users
FROM ({user_metrics(rec, test, k, users)}) m"""


def ranking_evaluated(rec: str, test: str, k: int = 5, users: str | None = None) -> str:
    return f"""
SELECT round(coalesce(avg("precision"), 0), 6) AS precision_at_k, round(coalesce(avg(ap), 0), 6) AS map_at_k,
  round(coalesce(avg(ndcg), 0), 6) AS ndcg_at_k, count(*) AS users
FROM ({user_metrics(rec, test, k, users)}) m"""


# Document vectors in long form, and per-user train parts of the scored pairs.
CTES["dims"] = """
SELECT vec_id AS article_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings"""
CTES["norms"] = "SELECT article_id, sqrt(sum(x * x)) AS norm FROM dims GROUP BY article_id"
CTES["user_ranked"] = """
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impression_time, article_id) AS nth,
  count(*) OVER (PARTITION BY user_id) AS n FROM scored"""
CTES["user_train"] = """
SELECT * FROM user_ranked
WHERE nth <= CASE WHEN n < 2 THEN n ELSE least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1) END"""
CTES["user_test"] = """
SELECT * FROM user_ranked
WHERE nth > CASE WHEN n < 2 THEN n ELSE least(CAST(floor(n * 0.8::DOUBLE) AS BIGINT), n - 1) END"""
CTES["profiles"] = """
SELECT t.user_id, d.d, sum(t.score * d.x) / sum(t.score) AS x
FROM user_train t JOIN dims d ON d.article_id = t.article_id WHERE t.score <> 0 GROUP BY t.user_id, d.d"""
CTES["profile_norms"] = "SELECT user_id, sqrt(sum(x * x)) AS norm FROM profiles GROUP BY user_id"
CTES["profile_scores"] = """
SELECT p.user_id, d.article_id, sum(p.x * d.x) / any_value(pn.norm * n.norm) AS score
FROM profiles p JOIN dims d ON d.d = p.d
JOIN norms n ON n.article_id = d.article_id JOIN profile_norms pn ON pn.user_id = p.user_id
GROUP BY p.user_id, d.article_id"""
CTES["rec_profile"] = top("""
SELECT s.* FROM profile_scores s WHERE NOT EXISTS (
  SELECT 1 FROM user_train t WHERE t.user_id = s.user_id AND t.article_id = s.article_id)""")
PROFILE = f"{SCORED} user_ranked user_train dims norms profiles profile_norms profile_scores"
CTES["cos_profiles"] = """
SELECT k.user_id, d.d, avg(d.x / n.norm) AS x
FROM known k JOIN dims d ON d.article_id = k.article_id JOIN norms n ON n.article_id = k.article_id
GROUP BY k.user_id, d.d"""
CTES["cos_norms"] = "SELECT user_id, sqrt(sum(x * x)) AS norm FROM cos_profiles GROUP BY user_id"
CTES["rec_cos"] = top("""
SELECT p.user_id, d.article_id, sum(p.x * d.x) / any_value(pn.norm * n.norm) AS score
FROM cos_profiles p JOIN dims d ON d.d = p.d
JOIN norms n ON n.article_id = d.article_id JOIN cos_norms pn ON pn.user_id = p.user_id
GROUP BY p.user_id, d.article_id""")

# Ring buffer of the ten oldest, or newest, known rows.
CTES["buffer"] = """
SELECT *, CAST(row_number() OVER (ORDER BY impression_time, impression_id) AS INTEGER) AS slot
FROM known QUALIFY slot <= 10"""
CTES["current"] = """
SELECT user_id, article_id AS current FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY impression_time DESC, impression_id DESC) AS nth FROM known) q
WHERE nth = 1"""
CTES["rec_ring"] = """
SELECT user_id, article_id, score, rank FROM (
  SELECT c.user_id, b.article_id, -CAST(b.slot AS DOUBLE) AS score,
    CAST(row_number() OVER (PARTITION BY c.user_id ORDER BY b.slot) AS INTEGER) AS rank
  FROM current c CROSS JOIN buffer b WHERE b.article_id <> c.current) q
WHERE rank <= 5"""
