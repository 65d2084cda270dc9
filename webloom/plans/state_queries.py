"""Queries that replay state machines over the events table, and choose resources."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom import api
from webloom.checkpointing import stream_folder
from webloom.functions import classify, urls
from webloom.operators import geo, jobs, ordered, pool
from webloom.operators.scrape import matched_results, merged_options
from webloom.plans.page_queries import STATUS
from webloom.session import table
from webloom.sources import inventory
from webloom.streaming import events as streams

QUERIES, ORACLE = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _events(spark, sf, *more):
    e = table(spark, sf, "events")
    return e.select((F.col("user_id") % 64).alias("pool"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.expr(f"coalesce({STATUS}, 500)").alias("status"), *more)


E = f"e AS (SELECT user_id % 64 AS pool, event_id, epoch_us(ts) / 1e6 AS t, coalesce({STATUS}, 500) AS status, row_number() OVER (PARTITION BY user_id % 64 ORDER BY event_id) AS n FROM events)"


@query(
    "rate_limit_slots",
    f"""WITH {E}, o AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY t, event_id) - 1 AS i FROM e)
    SELECT pool, event_id, round(max(t - i * 50.0) OVER (PARTITION BY pool ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 50.0, 3) AS slot FROM o""",
)
def rate_limit_slots(spark, sf):
    rows = ordered.token_slots(_events(spark, sf), "pool", ["t", "event_id"], "t", 0.02)
    return rows.select("pool", "event_id", F.round("slot", 3).alias("slot"))


KIND = "CASE WHEN status IN (429, 503) THEN 'slow' WHEN status BETWEEN 200 AND 399 THEN 'ok' ELSE 'other' END"


@query(
    "rate_limit_throttle",
    f"""WITH RECURSIVE e0 AS (SELECT user_id % 64 AS pool, event_id, epoch_us(ts) / 1e6 AS t, coalesce({STATUS}, 500) AS status FROM events),
    e AS (SELECT pool, event_id, t, {KIND} AS kind, row_number() OVER (PARTITION BY pool ORDER BY t, event_id) AS n FROM e0),
    r AS (SELECT pool, 0::BIGINT AS n, NULL::BIGINT AS event_id, 1.0::DOUBLE AS factor, -1e18::DOUBLE AS until FROM (SELECT DISTINCT pool FROM e)
      UNION ALL SELECT e.pool, e.n, e.event_id,
        CASE WHEN kind = 'slow' THEN greatest(0.1::DOUBLE, factor * 0.5::DOUBLE) WHEN kind = 'ok' AND t >= until AND factor < 1 THEN least(1.0::DOUBLE, factor * 1.5::DOUBLE) ELSE factor END,
        CASE WHEN kind = 'slow' THEN t + 60000.0::DOUBLE ELSE until END FROM r JOIN e ON e.pool = r.pool AND e.n = r.n + 1)
    SELECT pool, event_id, round(factor, 6) AS factor FROM r WHERE n > 0""",
)
def rate_limit_throttle(spark, sf):
    rows = _events(spark, sf).withColumn("kind", F.expr(KIND))
    return ordered.throttle(rows, "pool", ["t", "event_id"], "t", "kind", 60000.0).select("pool", "event_id", F.round("factor", 6).alias("factor"))


HEALTH_SQL = f"""WITH RECURSIVE {E},
    r AS (SELECT pool, 0::BIGINT AS n, NULL::BIGINT AS event_id, 1 AS session, 0.0::DOUBLE AS score, 0 AS usage, false AS retired FROM (SELECT DISTINCT pool FROM e)
      UNION ALL SELECT pool, n, event_id, session, score, usage, status IN (401, 403, 429) OR score >= 3 OR usage >= 50 FROM (
        SELECT e.pool, e.n, e.event_id, e.status, r.session + r.retired::INTEGER AS session,
          CASE WHEN e.status BETWEEN 200 AND 399 THEN greatest(0.0, CASE WHEN r.retired THEN 0.0 ELSE r.score END - 0.5) ELSE CASE WHEN r.retired THEN 0.0 ELSE r.score END + 1.0 END::DOUBLE AS score,
          CASE WHEN r.retired THEN 0 ELSE r.usage END + 1 AS usage FROM r JOIN e ON e.pool = r.pool AND e.n = r.n + 1))
    SELECT pool, event_id, session, score, usage, retired FROM r WHERE n > 0"""


@query("session_health", HEALTH_SQL)
def session_health(spark, sf):
    return ordered.session_health(_events(spark, sf), "pool", ["event_id"], "status").drop("status")


@query("session_last_stats", f"WITH h AS ({HEALTH_SQL}) SELECT pool, max_by(session, event_id) AS session, max_by(score, event_id) AS score, max_by(usage, event_id) AS usage FROM h GROUP BY pool")
def session_last_stats(spark, sf):
    return jobs.latest(session_health(spark, sf), "pool", ["event_id"], ["session", "score", "usage"])


COUNTRY = "['US', 'us ', 'DE', 'fr', 'BR', 'XX', NULL, 'CA'][event_id % 8 + 1]"
CITY = "['Chicago', NULL, 'Berlin', 'Paris', ' Manaus ', 'Chicago'][event_id % 6 + 1]"
#: Fixed values, written here apart from the engine's table: the countries that the query has, and the codes of all 250.
PROFILE_ROWS = (
    "('US', 'en-US', 'America/New_York', 'en-US,en;q=0.9'), ('DE', 'de-DE', 'Europe/Berlin', 'de-DE,de;q=0.9,en;q=0.8'), ('FR', 'fr-FR', 'Europe/Paris', 'fr-FR,fr;q=0.9,en;q=0.8'), "
    "('BR', 'pt-BR', 'America/Sao_Paulo', 'pt-BR,pt;q=0.9,en;q=0.8'), ('CA', 'en-CA', 'America/Toronto', 'en-CA,en;q=0.9,fr-CA;q=0.8,fr;q=0.7')"
)
CITY_ROWS = "('US', 'chicago', 'America/Chicago'), ('BR', 'manaus', 'America/Manaus')"
CODES = (
    "AD AE AF AG AI AL AM AO AQ AR AS AT AU AW AX AZ BA BB BD BE BF BG BH BI BJ BL BM BN BO BQ BR BS BT BV BW BY BZ CA CC CD CF CG CH CI CK CL CM CN CO CR CU CV CW CX CY CZ "
    "DE DJ DK DM DO DZ EC EE EG EH ER ES ET FI FJ FK FM FO FR GA GB GD GE GF GG GH GI GL GM GN GP GQ GR GS GT GU GW GY HK HM HN HR HT HU ID IE IL IM IN IO IQ IR IS IT JE JM JO JP "
    "KE KG KH KI KM KN KP KR KW KY KZ LA LB LC LI LK LR LS LT LU LV LY MA MC MD ME MF MG MH MK ML MM MN MO MP MQ MR MS MT MU MV MW MX MY MZ NA NC NE NF NG NI NL NO NP NR NU NZ OM "
    "PA PE PF PG PH PK PL PM PN PR PS PT PW PY QA RE RO RS RU RW SA SB SC SD SE SG SH SI SJ SK SL SM SN SO SR SS ST SV SX SY SZ TC TD TF TG TH TJ TK TL TM TN TO TR TT TV TW TZ "
    "UA UG UM US UY UZ VA VC VE VG VI VN VU WF WS XK YE YT ZA ZM ZW"
)


@query(
    "geo_profile_join",
    f"""WITH x AS (SELECT event_id, {COUNTRY} AS country, {CITY} AS city FROM events), p(cc, locale, tz, al) AS (VALUES {PROFILE_ROWS}), z(cc, city, tz) AS (VALUES {CITY_ROWS})
    SELECT event_id, locale, al AS accept_language, CASE WHEN p.cc IS NOT NULL THEN coalesce(z.tz, p.tz) END AS timezone
    FROM x LEFT JOIN p ON p.cc = upper(trim(country)) LEFT JOIN z ON z.cc = upper(trim(country)) AND z.city = lower(trim(x.city))""",
)
def geo_profile_join(spark, sf):
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (F.col("event_id") % n + 1).cast("int"))
    rows = table(spark, sf, "events").select(
        "event_id", pick(("US", "us ", "DE", "fr", "BR", "XX", None, "CA"), 8).alias("country"), pick(("Chicago", None, "Berlin", "Paris", " Manaus ", "Chicago"), 6).alias("city")
    )
    return geo.with_profile(rows, "country", "city", geo.profiles(spark), geo.cities(spark)).select("event_id", "locale", "accept_language", "timezone")


@query("geo_match", "SELECT c_custkey, coalesce(upper(n_name) = upper('france') AND contains(lower(c_mktsegment), 'auto'), false) AS ok FROM customer JOIN nation ON c_nationkey = n_nationkey")
def geo_match(spark, sf):
    rows = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", classify.geo_matches(F.col("n_name"), F.col("c_mktsegment"), F.lit("france"), F.lit("AUTO")).alias("ok"))


INVENTORY = """inv AS (SELECT s_suppkey::VARCHAR AS id, ['lte', 'residential_static', 'datacenter', 'residential_rotating'][s_nationkey % 4 + 1] AS category, s_suppkey AS seq,
    s_suppkey % 7 > 0 AND s_suppkey % 5 > 0 AND s_suppkey % 11 > 0 AS ok, s_acctbal < 0 AS tried FROM supplier)"""


def _inventory(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("lte", "residential_static", "datacenter", "residential_rotating")])
    k = F.col("s_suppkey")
    return table(spark, sf, "supplier").select(
        k.cast("string").alias("id"), F.element_at(kinds, F.col("s_nationkey") % 4 + 1).alias("category"), k.alias("seq"),
        F.when(k % 7 > 0, F.concat(F.lit("h"), k)).otherwise("").alias("url"), F.when(k % 5 > 0, "active").otherwise("paused").alias("status"), (k % 11 == 0).alias("expired"),
        (F.col("s_acctbal") < 0).alias("tried"),
    )


TYPES = ("mobile", "mobile_shared", "lte", "res_static", "dc_static", "rotating", "unknown")
CATEGORY_SQL = "CASE WHEN t IN ('mobile', 'mobile_shared', 'lte') THEN 'lte' WHEN t = 'rotating' THEN 'residential_rotating' WHEN t = 'dc_static' THEN 'datacenter' ELSE 'residential_static' END"


@query(
    "pool_select",
    f"""WITH {INVENTORY}, q AS (SELECT c_custkey AS request_id, {list(TYPES)}[c_custkey % 7 + 1] AS t, (c_custkey % 40 + 1)::VARCHAR AS pin FROM customer), a AS (SELECT * FROM inv WHERE ok AND NOT tried),
    f AS (SELECT category, min_by(id, seq) AS first_id FROM a GROUP BY category)
    SELECT request_id, c.category, coalesce(a.id, f.first_id) AS id FROM (SELECT request_id, pin, {CATEGORY_SQL} AS category FROM q) c
    LEFT JOIN a ON a.category = c.category AND a.id = c.pin LEFT JOIN f ON f.category = c.category""",
)
def pool_select(spark, sf):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("c_custkey") % 7 + 1).cast("int"))
    requests = table(spark, sf, "customer").select(F.col("c_custkey").alias("request_id"), classify.category(kind).alias("category"), (F.col("c_custkey") % 40 + 1).cast("string").alias("pin"))
    inventory = _inventory(spark, sf)
    return pool.select(requests, inventory, inventory.where("tried"))


@query(
    "pool_category_access",
    f"""SELECT s_suppkey, t AS type, {CATEGORY_SQL} AS category, CASE t WHEN 'mobile_shared' THEN a = 'shared' WHEN 'mobile' THEN a = 'private' WHEN 'res_static' THEN a = 'private' WHEN 'dc_static' THEN a = 'private' ELSE true END AS allowed
    FROM (SELECT s_suppkey, {list(TYPES)}[s_suppkey % 7 + 1] AS t, CASE WHEN s_suppkey % 2 = 0 THEN 'shared' ELSE 'private' END AS a FROM supplier)""",
)
def pool_category_access(spark, sf):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("s_suppkey") % 7 + 1).cast("int"))
    access = F.when(F.col("s_suppkey") % 2 == 0, "shared").otherwise("private")
    return table(spark, sf, "supplier").select("s_suppkey", kind.alias("type"), classify.category(kind).alias("category"), classify.access_allowed(kind, access).alias("allowed"))


@query("pool_diagnostics", f"WITH {INVENTORY} SELECT category, count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (tried) AS excluded FROM inv GROUP BY category")
def pool_diagnostics(spark, sf):
    inventory = _inventory(spark, sf)
    return pool.diagnostics(inventory, inventory.where("tried"))


ATTEMPTS = "SELECT o_orderkey AS job, l_linenumber - 1 AS attempt, l_linenumber % 4 = 0 OR l_quantity > 40 AS ok, l_discount < 0.08 AS failure, l_tax < 0.07 AS has_resource FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(
    "attempt_loop",
    f"""WITH a AS ({ATTEMPTS}), d AS (SELECT job, attempt, any_value(ok ORDER BY ok) AS ok, bool_and(failure) AS failure, bool_and(has_resource) AS has_resource FROM (SELECT job, attempt, bool_and(ok) AS ok, bool_and(failure) AS failure, bool_and(has_resource) AS has_resource FROM a GROUP BY ALL) GROUP BY ALL HAVING attempt < 5),
    s AS (SELECT *, coalesce(min(attempt) FILTER (ok OR NOT failure OR NOT has_resource) OVER (PARTITION BY job), max(attempt) OVER (PARTITION BY job)) AS stop FROM d)
    SELECT job, max_by(ok, attempt) AS ok, max(attempt) AS last_attempt, coalesce(max(attempt) FILTER (NOT ok AND failure), 0) AS retries FROM s WHERE attempt <= stop GROUP BY job""",
)
def attempt_loop(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("job"), (F.col("l_linenumber") - 1).alias("attempt"), ((F.col("l_linenumber") % 4 == 0) | (F.col("l_quantity") > 40)).alias("ok"),
        (F.col("l_discount") < 0.08).alias("failure"), (F.col("l_tax") < 0.07).alias("has_resource"),
    )
    rows = rows.groupBy("job", "attempt").agg(*[F.bool_and(c).alias(c) for c in ("ok", "failure", "has_resource")])
    return pool.attempts_result(rows, "job", 5)


THROTTLE_SQL = ORACLE["rate_limit_throttle"]


@query("stream_throttle", THROTTLE_SQL)
def stream_throttle(spark, sf):
    e = streams.read_events(spark, f"{sf}/events.parquet").select((F.col("user_id") % 64).alias("pool"), "event_id", (F.unix_micros("ts") / 1e6).alias("t"), F.expr(f"coalesce({STATUS}, 500)").alias("status"))
    rows = e.select("pool", "event_id", "t", F.expr(KIND).alias("kind"))
    out = streams.run_once(streams.throttle(rows, 60000.0), "stream_throttle", "append", stream_folder(spark, "stream"))
    return out.select("pool", "event_id", F.round("factor", 6).alias("factor"))


@query("options_and_headers", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'mobile' ELSE 'desktop' END AS device, 'false' AS screenshot, CASE WHEN event_id % 3 = 0 THEN 'fr' ELSE 'de' END AS lang, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n FROM events""")
def options_and_headers(spark, sf):
    over = F.when(F.col("event_id") % 2 == 0, F.expr("map('device', 'mobile')")).otherwise(F.expr("cast(map() as map<string, string>)"))
    user = F.when(F.col("event_id") % 3 == 0, F.expr("map('accept-language', 'fr')")).otherwise(F.expr("map('X-A', '1')"))
    headers = classify.merged_headers(F.expr("map('Accept-Language', 'de')"), user)
    rows = table(spark, sf, "events").select("event_id", merged_options(F.expr("map('device', 'desktop', 'screenshot', 'false')"), over).alias("o"), headers.alias("h"))
    return rows.select("event_id", F.col("o")["device"].alias("device"), F.col("o")["screenshot"].alias("screenshot"), F.coalesce(F.col("h")["accept-language"], F.col("h")["Accept-Language"]).alias("lang"), F.size("h").alias("n"))


@query("task_results", "SELECT o_orderkey AS job, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1")
def task_results(spark, sf):
    tasks = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("job"))
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"))
    return matched_results(tasks, results, "job").groupBy("job").agg(F.count(F.lit(1)).alias("n"))


@query("job_lookup", "SELECT o_orderkey AS job, o_orderstatus AS status FROM orders WHERE o_orderkey = 7")
def job_lookup(spark, sf):
    return api.get_job(table(spark, sf, "orders").select(F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status")), 7)


@query(
    "country_list",
    f"""WITH l AS (SELECT string_split('{CODES}', ' ') AS codes), c AS (SELECT ' ' || lower(codes[c_custkey * 7 % 200 + 1]) AS code FROM customer, l)
    SELECT country, count(code) AS customers FROM (SELECT unnest(codes) AS country FROM l) LEFT JOIN c ON upper(trim(code)) = country GROUP BY country""",
)
def country_list(spark, sf):
    """Every country of the dimension with its customers; customers have codes as people write them."""
    code = F.element_at(F.split(F.lit(CODES), " "), (F.col("c_custkey") * 7 % 200 + 1).cast("int"))
    rows = table(spark, sf, "customer").select(F.upper(F.trim(F.concat(F.lit(" "), F.lower(code)))).alias("country"))
    counts = rows.groupBy("country").agg(F.count(F.lit(1)).alias("customers"))
    return api.list_countries(spark).join(counts, "country", "left").select("country", F.coalesce("customers", F.lit(0)).alias("customers"))


@query("fetch_taxonomy", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN true WHEN event_id % 5 = 1 THEN status >= 500 OR status IN (408, 429) WHEN event_id % 5 = 2 THEN true ELSE false END AS retryable
    FROM (SELECT event_id, """ + f"coalesce({STATUS}, 500)" + """ AS status FROM events)""")
def fetch_taxonomy(spark, sf):
    k = F.col("event_id") % 5
    stage = F.when(k == 0, "connect").otherwise("answer")
    status = F.when(k == 1, F.expr(f"coalesce({STATUS}, 500)"))
    job = F.when(k == 2, "failed").when(k == 3, "cancelled")
    return table(spark, sf, "events").select("event_id", classify.fetch_failure_retryable(stage, status, job).alias("retryable"))


@query("inventory_ingest", "SELECT s_suppkey::VARCHAR AS id, 'active' AS status, s_suppkey % 2 = 0 AS expired, 'h' || s_suppkey AS url FROM supplier")
def inventory_ingest(spark, sf):
    item = F.to_json(F.struct(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("h"), F.col("s_suppkey")).alias("url"), F.lit("ACTIVE").alias("system_status"), F.when(F.col("s_suppkey") % 2 == 0, True).alias("expired")))
    body = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit('{"results": ['), item, F.lit("]}"))).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return inventory.inventory(table(spark, sf, "supplier").select(body.alias("body")), "body").select("id", "status", "expired", "url")


@query("request_ingest", "SELECT page_id, url, 'desktop' AS device, true AS render, CASE WHEN page_id % 2 = 0 THEN 5000 END::BIGINT AS timeout_ms FROM pages")
def request_ingest(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.to_json(F.struct("url", F.when(F.col("page_id") % 2 == 0, 5000).alias("timeout_ms"), F.create_map(F.lit("p"), F.col("page_id").cast("string")).alias("headers"))).alias("body"))
    return inventory.requests(pages, "body").select(F.col("headers")["p"].cast("bigint").alias("page_id"), "url", "device", "render", "timeout_ms")


@query("cookie_defaults", "SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS domain, '/' AS path FROM pages")
def cookie_defaults(spark, sf):
    bare = F.expr("array(named_struct('name', 'n', 'value', 'v', 'domain', cast(null as string), 'path', cast(null as string)))")
    rows = table(spark, sf, "pages").select("page_id", F.get(urls.cookies_with_defaults(bare, F.col("url")), F.lit(0)).alias("c"))
    return rows.select("page_id", "c.domain", "c.path")


@query(
    "scrape_pages",
    """SELECT p.page_id::VARCHAR AS request_id, p.page_id % 4 <> 0 AND p.page_id % 9 <> 0 AS ok, CASE WHEN p.page_id % 4 = 0 THEN NULL WHEN p.page_id % 5 = 0 THEN 404 ELSE 200 END AS status_code,
    CASE WHEN p.page_id % 4 = 0 THEN 'page not in store' WHEN p.page_id % 9 = 0 AND p.page_id % 5 = 0 THEN 'Captcha/block detected by heuristic; status_code=404'
      WHEN p.page_id % 9 = 0 THEN 'Captcha/block detected by heuristic' WHEN p.page_id % 5 = 0 THEN 'status_code=404' ELSE '' END AS warnings FROM pages p""",
)
def scrape_pages(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("https://h.example.com/"), F.col("page_id")).alias("url"), "html")
    store = pages.where("page_id % 4 <> 0").select(F.concat("url", F.lit("#x")).alias("url"), F.when(F.col("page_id") % 9 == 0, "<p>Access denied").otherwise(F.col("html")).alias("html"), F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status_code"))
    out = api.scrape_pages(pages.select(F.col("page_id").cast("string").alias("request_id"), "url"), store)
    return out.select("request_id", "ok", "status_code", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "limiter_snapshot",
    THROTTLE_SQL.replace("SELECT pool, event_id, round(factor, 6) AS factor FROM r WHERE n > 0", "SELECT pool, CASE WHEN 2e9 < max_by(until, n) THEN max_by(factor, n) ELSE 1.0 END AS factor FROM r WHERE n > 0 GROUP BY pool"),
)
def limiter_snapshot(spark, sf):
    rows = _events(spark, sf).withColumn("kind", F.expr(KIND))
    states = ordered.throttle(rows, "pool", ["t", "event_id"], "t", "kind", 60000.0)
    return jobs.limiter_snapshot(states, "pool", ["t", "event_id"], F.lit(2e9))


@query(
    "resource_recovery",
    f"""WITH RECURSIVE {INVENTORY}, f AS (SELECT (user_id % 97)::VARCHAR AS job, {list(TYPES)}[user_id % 7 + 1] AS t, event_id % 3 = 0 AS works,
      row_number() OVER (PARTITION BY user_id % 97, {list(TYPES)}[user_id % 7 + 1] ORDER BY event_id, event_id % 3 = 0) AS k FROM events WHERE event_type = 'error'),
    ids AS (SELECT category, list(id ORDER BY seq, id) AS ids FROM inv WHERE ok GROUP BY category),
    j AS (SELECT DISTINCT job, t, ids FROM (SELECT job, t, {CATEGORY_SQL} AS category FROM f) x JOIN ids USING (category)),
    r AS (SELECT job, t, ids, 0::BIGINT AS k, ids[1] AS cur, []::VARCHAR[] AS gone, [ids[1]] AS path FROM j
      UNION ALL SELECT job, t, ids, k, CASE WHEN keep THEN cur ELSE list_filter(ids, lambda i: NOT list_contains(out, i))[1] END, out,
        list_append(path, CASE WHEN keep THEN cur ELSE list_filter(ids, lambda i: NOT list_contains(out, i))[1] END)
      FROM (SELECT r.job, r.t, r.ids, f.k, r.cur, r.path, r.t IN ('mobile', 'lte') AND f.works AS keep,
        CASE WHEN r.t IN ('res_rotating', 'residential_rotating', 'rotating') OR r.cur IS NULL OR list_contains(r.gone, r.cur) THEN r.gone ELSE list_append(r.gone, r.cur) END AS out
        FROM r JOIN f ON f.job = r.job AND f.t = r.t AND f.k = r.k + 1))
    SELECT job, t AS type, len(path)::INTEGER AS n, array_to_string(list_filter(path, lambda p: p IS NOT NULL), ',') AS path FROM r
    QUALIFY row_number() OVER (PARTITION BY job, t ORDER BY k DESC) = 1""",
)
def resource_recovery(spark, sf):
    fails = table(spark, sf, "events").where("event_type = 'error'").select(
        (F.col("user_id") % 97).cast("string").alias("job"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (F.col("user_id") % 7 + 1).cast("int")).alias("type"),
        F.col("event_id").alias("seq"), (F.col("event_id") % 3 == 0).alias("change_works"),
    )
    return pool.recover(fails, _inventory(spark, sf)).select("job", "type", F.size("path").alias("n"), F.array_join("path", ",").alias("path"))


