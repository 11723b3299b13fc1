"""Privacy, acquisition, leads, quotas, validation and their streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plotline import fixed_values as fixed
from plotline.catalog.entries import part, query
from plotline.functions import events as ev
from plotline.functions import privacy
from plotline.operators import leads as le
from plotline.session import checkpoint_folder, settle
from plotline.sources import sample_market as sm
from plotline.streaming import addresses as ad
from plotline.streaming import events as st

SITE = "site.example"


# --- Privacy ----------------------------------------------------------------

_EMAIL = "trim(coalesce(email, ''))"


#: The two nested hashes of the keyed hash, over the padded key "secret".
_PADS = [bytes(b ^ pad for b in b"secret".ljust(64, b"\0")).hex() for pad in (0x36, 0x5C)]


@query(
    "P02_P03_keyed_hashes",
    f"""SELECT event_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(trim(ip))))) AS ip_hmac,
        CASE WHEN trim(user_agent) <> '' THEN sha256(trim(user_agent)) END AS ua_hash FROM hit_rows""",
)
def keyed_hashes(spark, d):
    """Keyed hash of the address and hash of the agent."""
    return sm.hits(spark, d).select(
        "event_id", privacy.keyed_ip(F.col("ip"), "secret").alias("ip_hmac"),
        privacy.hashed_agent(F.col("user_agent")).alias("ua_hash"),
    )


@query(
    "P04_masked_emails",
    f"""SELECT lead_row, CASE WHEN {_EMAIL} = '' THEN '' WHEN strpos({_EMAIL}, '@') <= 1 THEN '***'
        ELSE left({_EMAIL}, 1) || '***' || CASE WHEN length(regexp_extract({_EMAIL}, '^(.+)@[^@]*$', 1)) > 2
          THEN right(regexp_extract({_EMAIL}, '^(.+)@[^@]*$', 1), 1) ELSE '' END || '@' || regexp_extract({_EMAIL}, '@([^@]*)$', 1) END AS masked FROM lead_rows""",
)
def masked_emails(spark, d):
    return sm.leads(spark, d).select("lead_row", privacy.masked_email(F.col("email")).alias("masked"))


_BARE = "(CASE WHEN trim(phone) LIKE '+%' THEN '+' ELSE '' END || regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'))"
_PHONE = "coalesce(" + ", ".join(f"'{prefix}' || nullif(regexp_extract({_BARE}, '{form}', 1), '')" for form, prefix in fixed.PHONE_FORMS) + ", '')"
_HASHES = f"""CASE WHEN strpos(lower({_EMAIL}), '@') > 1 THEN sha256(lower({_EMAIL})) END AS email_hash,
  CASE WHEN {_PHONE} <> '' THEN sha256({_PHONE}) END AS phone_hash"""


@query("P05_contact_hashes", f"SELECT lead_row, {_PHONE} AS phone, {_HASHES} FROM lead_rows")
def contact_hashes(spark, d):
    phone = privacy.international_phone(F.col("phone"))
    return sm.leads(spark, d).select(
        "lead_row", phone.alias("phone"),
        privacy.contact_hash(privacy.plain_email(F.col("email"))).alias("email_hash"),
        privacy.contact_hash(phone).alias("phone_hash"),
    )


@query(
    "P06_clean_parameters",
    """SELECT event_id, CASE WHEN user_agent <> '' THEN 'agent=' || user_agent || ';' ELSE '' END || 'step=' || event_type AS parameters,
       CASE WHEN event_id % 2 = 0 THEN sha256(ip) END AS hash FROM hit_rows""",
)
def clean_parameters(spark, d):
    raw = F.create_map(
        F.lit("agent"), F.col("user_agent"), F.lit("Email"), F.lit("a@b.example"), F.lit("step"), F.col("event_type"),
        F.lit("note"), F.lit(None).cast("string"),
    )
    hashed = F.when(F.col("event_id") % 2 == 0, F.sha2("ip", 256)).otherwise(F.col("ip"))
    user = ev.clean_user_data(F.create_map(F.lit("sha256_email_address"), hashed))
    entries = F.array_sort(F.map_entries(ev.clean_parameters(raw)))
    text = F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return sm.hits(spark, d).select(
        "event_id", text.alias("parameters"), F.try_element_at(user, F.lit("sha256_email_address")).alias("hash")
    )


# --- Acquisition ------------------------------------------------------------


def _parameter(name: str) -> str:
    value = f"left(trim(url_decode(regexp_extract(href, '[?&]{name}=([^&#]*)', 1))), 120)"
    return f"nullif({value}, '')"


_FIELDS = ", ".join(f'{_parameter(p)} AS "{n}"' for p, n in fixed.CAMPAIGN_PARAMETERS.items())
part("touches", f"""
  SELECT event_id, session_id, ts, {_FIELDS}, nullif(lower(regexp_extract(referrer, '^https?://([^/?#:]+)', 1)), '') AS host,
    regexp_extract(href, '^https?://[^/]+([^?#]*)', 1) AS "landingPage" FROM hit_rows""")
part("blocks", f"""
  SELECT * EXCLUDE (host), CASE WHEN host <> '{SITE}' THEN host END AS referrer,
    coalesce(gclid, source, campaign, "campaignId") IS NOT NULL AS paid FROM touches""")
def _map(table: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + "}"


_LABELS = _map({k: label for k, (label, _) in fixed.CHANNEL_OF_MEDIUM.items()})
_BEHIND = _map({k: "yes" for k, (_, with_source) in fixed.CHANNEL_OF_MEDIUM.items() if with_source})
_CHANNEL = f"""coalesce(CASE WHEN gclid IS NOT NULL THEN '{fixed.CHANNEL_OF_CLICK}' END, {_map(fixed.CHANNEL_OF_SOURCE)}[lower(source)],
  {_LABELS}[lower(medium)] || coalesce(' (' || CASE WHEN {_BEHIND}[lower(medium)] = 'yes' THEN lower(source) END || ')', ''),
  lower(source) || coalesce(' (' || lower(medium) || ')', ''),
  CASE WHEN regexp_matches(referrer, '{fixed.SEARCH_ENGINES}') THEN '{fixed.CHANNEL_OF_SEARCH} (' ELSE '{fixed.CHANNEL_OF_SITE} (' END || referrer || ')', '{fixed.CHANNEL_OF_NOTHING}')"""
_NAMES = [*fixed.CAMPAIGN_PARAMETERS.values(), "referrer", "landingPage"]
_QUOTED = ", ".join(f'"{n}"' for n in _NAMES)


@query("E01_E03_acquisition", f"SELECT event_id, {_QUOTED}, {_CHANNEL} AS channel FROM blocks")
def acquisition(spark, d):
    block = ev.acquisition(F.col("href"), F.col("referrer"), SITE)
    rows = sm.hits(spark, d).select("event_id", block.alias("b"))
    return rows.select("event_id", *[F.col(f"b.{n}").alias(n) for n in _NAMES], ev.channel(F.col("b")).alias("channel"))


part("attributed", f"""
  SELECT *, {_CHANNEL} AS channel FROM blocks
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY paid DESC, CASE WHEN paid THEN -epoch_us(ts) ELSE epoch_us(ts) END,
    CASE WHEN paid THEN -event_id ELSE event_id END) = 1""")


@query("E02_session_attribution", f"SELECT session_id, {_QUOTED}, channel FROM attributed")
def session_attribution(spark, d):
    rows = le.session_attribution(sm.hits(spark, d), SITE)
    return rows.select("session_id", *[F.col(f"block.{n}").alias(n) for n in _NAMES], "channel")


def _run_stream(spark, stream, mode="append"):
    """Run a stream over what is there and read back what it wrote."""
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    st.run_available(stream, f"{base}/out", f"{base}/state", mode)
    return spark.read.parquet(f"{base}/out")


def _hit_stream(spark, d):
    events = st.event_stream(spark, f"{d}/events.parquet", "events.parquet")
    return spark.sql(sm.HITS, events=events)


def _in_batches(spark, rows, stream, heartbeat, count=3):
    """Run a stream over ``count`` files of rows in order of time, then over heartbeats that close what is open."""
    base = f"{checkpoint_folder(spark)}/batches-{uuid.uuid4().hex}"
    rows = settle(rows)
    cuts = rows.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [i / count for i in range(1, count)], 0.01)
    edges = [float("-inf"), *cuts, float("inf")]
    at = F.unix_micros("ts")
    parts = [rows.where((at > low) & (at <= high)) for low, high in zip(edges[:-1], edges[1:], strict=True)]
    late = rows.agg((F.max("ts") + F.expr("INTERVAL 30 DAYS")).alias("late")).first().late
    for number, part_rows in enumerate([*parts, heartbeat(late), heartbeat(late)]):
        part_rows.select(*rows.columns).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        st.run_available(stream(source), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out")


@query(
    "T01_stream_attribution",
    """WITH t AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 24 HOUR, true)::INT AS fresh FROM blocks WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id)),
       v AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS visit FROM t)
       SELECT session_id, strftime(min(ts) OVER (PARTITION BY session_id, visit), '%Y-%m-%d %H:%M:%S') AS started, paid AS campaign, gclid, source, "landingPage" FROM v
       QUALIFY row_number() OVER (PARTITION BY session_id, visit ORDER BY paid DESC, CASE WHEN paid THEN -epoch_us(ts) ELSE epoch_us(ts) END, CASE WHEN paid THEN -event_id ELSE event_id END) = 1""",
)
def stream_attribution(spark, d):
    """Visits over three batches; a visit may go on in the next batch, and a session returns for another."""
    hits = sm.hits(spark, d).select("session_id", "ts", "event_id", "href", "referrer")
    beat = lambda late: spark.createDataFrame([(-1, late, -1, "https://site.example/", "")], hits.schema)
    rows = _in_batches(spark, hits, lambda source: st.attribution(source, SITE), beat)
    field = lambda n: F.get_json_object("block", f"$.{n}").alias(n)
    return rows.select("session_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "campaign", field("gclid"), field("source"), field("landingPage"))


@query("T02_stream_conversions", "SELECT DISTINCT 'lead-' || (event_id // 3) AS lead_id FROM events")
def stream_conversions(spark, d):
    leads = _hit_stream(spark, d).withColumn("lead_id", F.concat(F.lit("lead-"), F.expr("event_id div 3").cast("string")))
    return _run_stream(spark, st.conversions(leads.select("lead_id", "ts"))).select("lead_id")


@query(
    "T03_quota_breaches",
    """SELECT 'estimation' AS scope, user_id AS client, date_trunc('hour', ts)::VARCHAR AS window_start, count(*) AS requests
       FROM events GROUP BY 2, date_trunc('hour', ts) HAVING count(*) > 2""",
)
def quota_breaches(spark, d):
    calls = sm.hits(spark, d).select("ts", F.col("session_id").alias("client"))
    found = le.quota_breaches(calls, "estimation", 2, "1 hour")
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_STREAM_CALLS = """SELECT CASE event_id % 7 WHEN 0 THEN 'global' WHEN 1 THEN 'geocode' WHEN 2 THEN 'marche' WHEN 3 THEN 'estimation' WHEN 4 THEN 'estimation_daily' WHEN 5 THEN 'lead' ELSE 'lead_daily' END AS scope,
  CAST(user_id % 2 AS BIGINT) AS client, date_trunc('week', CAST(ts AS TIMESTAMP)) + CASE WHEN event_id % 3 = 0 THEN INTERVAL 1 MINUTE ELSE INTERVAL 0 MINUTE END AS ts FROM {events}"""
_LIMIT_ROWS = ", ".join(f"('{scope}', {text.split('/')[0].strip()}, '{text.split('/')[1].strip()}')" for scope, text in fixed.QUOTAS)


@query(
    "T03_quota_breach_stream",
    f"""SELECT scope, client, strftime(CASE WHEN duration = '1 day' THEN date_trunc('day', ts) ELSE date_trunc('minute', ts) END, '%Y-%m-%d %H:%M:%S') AS window_start, duration, count(*) AS requests
        FROM ({_STREAM_CALLS.format(events='events')}) JOIN (VALUES {_LIMIT_ROWS}) q(scope, allowed, duration) USING (scope) GROUP BY 1, 2, 3, 4, allowed HAVING count(*) > allowed""",
)
def quota_breach_stream(spark, d):
    """All seven allowances over three batches; heartbeats close the last windows."""
    calls = sm.on_spark(spark, d, _STREAM_CALLS)
    beat = lambda late: spark.createDataFrame([("global", -1, late)], calls.schema)
    found = _in_batches(spark, calls, lambda source: st.breaches(source, le.quota_table(spark)), beat)
    return found.select("scope", "client", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "duration", "requests")


_RESOLVED = f"""SELECT address, postal_code, city, label, lon, lat, 1 AS batch, TIMESTAMP '2001-07-01 08:00:00' AS resolved_at, expires_on FROM ({sm.ADDRESSES}) a
  UNION ALL SELECT address, postal_code, city, concat(label, ' anew'), lon, lat, 2, TIMESTAMP '2001-07-15 08:00:00', CAST('2001-12-01' AS DATE) FROM ({sm.ADDRESSES}) a WHERE label LIKE '%3'
  UNION ALL SELECT address, postal_code, city, label, lon, lat, 3, TIMESTAMP '2001-07-30 08:00:00', CAST('2001-07-29' AS DATE) FROM ({sm.ADDRESSES}) a WHERE label LIKE '%7'
  UNION ALL SELECT address, postal_code, city, concat(label, ' too late'), lon, lat, 3, TIMESTAMP '2001-06-30 08:00:00', CAST('2001-12-31' AS DATE) FROM ({sm.ADDRESSES}) a WHERE label LIKE '%1'"""


@query(
    "T06_live_addresses",
    f"""SELECT address, postal_code, city, label, lon, lat, expires_on::VARCHAR AS expires_on FROM ({_RESOLVED.format(customer='customer')})
        QUALIFY row_number() OVER (PARTITION BY address, postal_code, city ORDER BY resolved_at DESC, expires_on DESC, label DESC, lon DESC, lat DESC, batch DESC) = 1 AND expires_on >= DATE '2001-08-01'""",
)
def live_addresses(spark, d):
    """Addresses after three batches: renewed ones, ones that have expired meanwhile, and news that came too late."""
    base, keys = f"{checkpoint_folder(spark)}/live-{uuid.uuid4().hex}", ["address", "postal_code", "city"]
    rows = settle(sm.on_spark(spark, d, _RESOLVED))
    for number in (1, 2, 3):
        rows.where(F.col("batch") == number).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        ad.keep_live(stream, f"{base}/table", f"{base}/state", keys)
    found = ad.live_addresses(spark, f"{base}/table", sm.REFERENCE_DATE)
    return found.select(*keys, "label", "lon", "lat", F.col("expires_on").cast("string").alias("expires_on"))


_ALLOWANCES = """SELECT event_id AS scope_id, CASE event_id % 4 WHEN 0 THEN concat(CAST(event_id % 50 AS STRING), '/1 minute')
  WHEN 1 THEN '60 / 1 day' WHEN 2 THEN 'lots' ELSE ' 5/1 minute ' END AS allowance FROM {events}"""


@query(
    "T03_allowances",
    f"""SELECT requests, duration, count(*) AS n FROM (SELECT TRY_CAST(regexp_extract(trim(allowance), '^(\\d+)\\s*/\\s*(.+)$', 1) AS INT) AS requests,
        trim(regexp_extract(trim(allowance), '^(\\d+)\\s*/\\s*(.+)$', 2)) AS duration FROM ({_ALLOWANCES.format(events='events')})) WHERE requests > 0 GROUP BY 1, 2""",
)
def allowances(spark, d):
    rows = sm.on_spark(spark, d, _ALLOWANCES).withColumn("scope", F.col("scope_id").cast("string"))
    return le.parse_allowances(rows).groupBy("requests", "duration").agg(F.count("*").alias("n"))


@query(
    "T04_scraping_days",
    """SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS requests, count(DISTINCT user_id) AS clients FROM events
       GROUP BY 1 HAVING count(*) > 300 AND count(DISTINCT user_id) < 150""",
)
def scraping_days(spark, d):
    calls = sm.hits(spark, d).select("ts", F.col("session_id").alias("client"))
    return le.scraping_days(calls, 300, 150).withColumn("day", F.col("day").cast("string"))


# --- Leads ------------------------------------------------------------------

_BUCKET = "CASE WHEN {0} IS NULL OR {0} <= 0 THEN '' " + " ".join(f"WHEN {{0}} <= {t} THEN '{n}'" for t, n in fixed.SURFACE_BUCKETS) + " ELSE '200+' END"
_QUALITY = "CASE WHEN is_owner = 'yes' THEN CASE want_to_sell WHEN 'yes' THEN 'hot' WHEN 'maybe' THEN 'warm' ELSE 'cold' END ELSE 'cold' END"
_VALUE = """floor(100 * CASE WHEN is_owner = 'yes' THEN CASE want_to_sell WHEN 'yes' THEN 3e0 WHEN 'maybe' THEN 15e-1 ELSE 5e-1 END ELSE 2e-1 END
  * CASE WHEN estimation_mid > 0 THEN least(25e-1, floor(estimation_mid + 5e-1) / 250000) ELSE 1 END * 1e2 + 0.5) / 1e2"""


@query(
    "E04_E05_E06_E07_lead_scores",
    f"""SELECT lead_row, {_BUCKET.format('surface')} AS bucket, {_QUALITY} AS quality, {_VALUE} AS value,
        CASE WHEN lower(subject) = 'partenariat' THEN 10 ELSE 50 END AS contact_value FROM lead_rows""",
)
def lead_scores(spark, d):
    price = F.when(F.col("estimation_mid") > 0, F.floor(F.col("estimation_mid") + 0.5).cast("double"))
    return sm.leads(spark, d).select(
        "lead_row", ev.surface_bucket(F.col("surface")).alias("bucket"),
        ev.lead_quality(F.col("is_owner"), F.col("want_to_sell")).alias("quality"),
        ev.lead_value(F.col("is_owner"), F.col("want_to_sell"), price).alias("value"),
        ev.contact_value(F.col("subject")).alias("contact_value"),
    )


@query(
    "E08_page_types",
    f"""SELECT path, count(*) AS n, coalesce(CASE WHEN more <> '' THEN {_map({k: v[1] for k, v in fixed.PAGE_TYPES.items()})}[root] ELSE {_map({k: v[0] for k, v in fixed.PAGE_TYPES.items()})}[root] END,
       '{fixed.PAGE_TYPE_ELSE}') AS page_type FROM (SELECT "landingPage" AS path, split_part("landingPage", '/', 2) AS root, split_part("landingPage", '/', 3) AS more FROM blocks) GROUP BY 1, 3""",
)
def page_types(spark, d):
    path = ev.acquisition(F.col("href"), F.col("referrer"), SITE)["landingPage"]
    return (
        sm.hits(spark, d)
        .groupBy(path.alias("path"), ev.page_type(path).alias("page_type"))
        .agg(F.count("*").alias("n"))
    )


@query("E09_one_conversion", "SELECT lead_id, min(lead_row) AS lead_row FROM lead_rows GROUP BY 1")
def one_conversion(spark, d):
    return le.one_conversion(sm.leads(spark, d), "lead_row").select("lead_id", "lead_row")


@query(
    "C12_E10_lead_facts",
    f"""SELECT lead_id, kind, status, property_type, surface, postal_code, is_owner, want_to_sell,
        CASE WHEN estimation_mid > 0 THEN floor(estimation_mid + 0.5) END AS estimation_value, {_QUALITY} AS lead_quality,
        CASE WHEN kind = 'contact' THEN CASE WHEN lower(subject) = 'partenariat' THEN 10 ELSE 50 END ELSE {_VALUE} END AS lead_value,
        {_BUCKET.format('surface')} AS surface_bucket, left(postal_code, 2) AS department, {_HASHES} FROM lead_rows WHERE trim(website) = ''""",
)
def lead_facts(spark, d):
    return le.flat_leads(le.without_bots(sm.leads(spark, d)))


@query(
    "S11_contact_export",
    """SELECT lead_row AS "ID", name AS "Nom", email AS "Email", coalesce(phone, 'N/A') AS "Téléphone", subject AS "Sujet",
       replace(message, chr(10), ' ') AS "Message" FROM lead_rows""",
)
def contact_export(spark, d):
    return le.contact_export(sm.leads(spark, d))


# --- Validation -------------------------------------------------------------

_BROKEN = """SELECT request_id, CASE WHEN request_id % 23 = 0 THEN 'ab' ELSE address END AS address, CASE WHEN request_id % 29 = 0 THEN '7500' ELSE postal_code END AS postal_code,
  city, CASE WHEN request_id % 31 = 0 THEN 'chateau' ELSE property_type END AS property_type, CASE WHEN request_id % 37 = 0 THEN 5e0 ELSE surface END AS surface,
  CASE WHEN request_id % 11 = 0 THEN NULL ELSE rooms END AS rooms, CASE WHEN request_id % 41 = 0 THEN 'H' ELSE dpe END AS dpe,
  CASE WHEN request_id % 43 = 0 THEN 51 ELSE floor END AS floor, outdoor, condition, terrain_size, CASE WHEN request_id % 47 = 0 THEN 60e0 ELSE lat END AS lat, lon FROM {rows}"""


@query(
    "C10_request_errors",
    f"""SELECT request_id, array_to_string(list_filter([
        CASE WHEN length(trim(address)) NOT BETWEEN 3 AND 200 THEN 'address:length' END, CASE WHEN NOT regexp_matches(postal_code, '^\\d{{5}}$') THEN 'postalCode:regex' END,
        CASE WHEN property_type NOT IN ('appartement', 'maison', 'terrain', 'local-commercial') THEN 'propertyType:enum' END,
        CASE WHEN surface NOT BETWEEN 1 AND 100000 THEN 'surface:bounds' END,
        CASE WHEN property_type = 'terrain' AND surface NOT BETWEEN 1 AND 100000 OR property_type <> 'terrain' AND surface NOT BETWEEN 9 AND 1000 THEN 'surface:range' END,
        CASE WHEN rooms NOT BETWEEN 1 AND 30 THEN 'rooms:range' END, CASE WHEN property_type <> 'terrain' AND rooms IS NULL THEN 'rooms:required' END,
        CASE WHEN dpe NOT IN ('A','B','C','D','E','F','G','unknown') THEN 'dpe:enum' END, CASE WHEN floor NOT BETWEEN 0 AND 50 THEN 'floor:range' END,
        CASE WHEN lat NOT BETWEEN -22 AND 52 THEN 'lat:range' END, CASE WHEN lon NOT BETWEEN -63 AND 56 THEN 'lon:range' END], lambda x: x IS NOT NULL), ',') AS errors
        FROM ({_BROKEN.format(rows='request_rows')})""",
)
def request_errors(spark, d):
    rows = spark.sql(_BROKEN, rows=sm.requests(spark, d))
    text = F.array_join(F.transform(le.request_errors(), lambda e: F.concat_ws(":", e["field"], e["rule"])), ",")
    return rows.select("request_id", text.alias("errors"))


@query(
    "C11_lead_errors",
    rf"""SELECT lead_row, array_to_string(list_filter([CASE WHEN kind NOT IN ('estimation', 'contact') THEN 'kind:enum' END,
        CASE WHEN length(trim(name)) NOT BETWEEN 2 AND 100 THEN 'name:length' END,
        CASE WHEN NOT regexp_matches({_EMAIL}, '^[^@\s]+@[^@\s]+\.[^@\s]+$') OR length({_EMAIL}) > 180 THEN 'email:email' END,
        CASE WHEN NOT regexp_matches(trim(phone), '^[+0-9 ().\-/]{{6,30}}$') THEN 'phone:regex' END,
        CASE WHEN kind = 'contact' AND coalesce(trim(message), '') = '' THEN 'message:required' END], lambda x: x IS NOT NULL), ',') AS errors FROM lead_rows""",
)
def lead_errors(spark, d):
    text = F.array_join(F.transform(le.lead_errors(), lambda e: F.concat_ws(":", e["field"], e["rule"])), ",")
    return sm.leads(spark, d).select("lead_row", text.alias("errors"))


@query(
    "C13_visible_fields",
    """SELECT request_id, CASE WHEN property_type = 'appartement' THEN floor END AS floor, CASE WHEN property_type = 'appartement' THEN has_elevator END AS has_elevator,
       CASE WHEN property_type IN ('appartement', 'maison') THEN outdoor END AS outdoor, CASE WHEN property_type IN ('appartement', 'maison') THEN condition END AS condition,
       CASE WHEN property_type = 'maison' AND request_id % 2 = 0 THEN terrain_size END AS terrain_size FROM request_rows""",
)
def visible_fields(spark, d):
    rows = sm.requests(spark, d).withColumn("has_terrain", F.when(F.col("request_id") % 2 == 0, "yes").otherwise("no"))
    return le.visible_fields(rows).select("request_id", "floor", "has_elevator", "outdoor", "condition", "terrain_size")


_FORMS = """SELECT request_id, CASE WHEN request_id % 7 = 0 THEN '' WHEN request_id % 2 = 0 THEN '65,5' WHEN request_id % 3 = 0 THEN concat(' ', CAST(request_id AS STRING), ',50 m²') WHEN request_id % 5 = 0 THEN 'Infinity' ELSE CAST(request_id AS STRING) END AS surface,
  CASE request_id % 4 WHEN 0 THEN '3' WHEN 1 THEN '2.5' WHEN 2 THEN 'x' END AS rooms, CASE request_id % 3 WHEN 0 THEN '-1' WHEN 1 THEN '4' ELSE '' END AS floor,
  CASE request_id % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unknown' ELSE '' END AS has_elevator, CASE WHEN request_id % 5 = 0 THEN '' ELSE dpe END AS dpe,
  CASE WHEN request_id % 6 = 0 THEN 'loft' ELSE property_type END AS property_type, coalesce(outdoor, '') AS outdoor, coalesce(condition, '') AS condition FROM {rows}"""


@query(
    "C14_coerced_requests",
    f"""SELECT request_id, TRY_CAST(nullif(regexp_extract(replace(surface, ',', '.'), '^\\s*([0-9]+(\\.[0-9]*)?)', 1), '') AS DOUBLE) AS surface, CASE WHEN TRY_CAST(rooms AS DOUBLE) = floor(TRY_CAST(rooms AS DOUBLE)) THEN TRY_CAST(rooms AS DOUBLE)::INT END AS rooms,
        CASE WHEN TRY_CAST(floor AS DOUBLE) >= 0 THEN TRY_CAST(floor AS DOUBLE)::INT END AS floor, CASE has_elevator WHEN 'yes' THEN true WHEN 'no' THEN false END AS has_elevator,
        CASE WHEN dpe IN ('A','B','C','D','E','F','G','unknown') THEN dpe ELSE 'unknown' END AS dpe, CASE WHEN property_type <> 'loft' THEN property_type END AS property_type,
        nullif(outdoor, '') AS outdoor, nullif(condition, '') AS condition FROM ({_FORMS.format(rows='request_rows')})""",
)
def coerced_requests(spark, d):
    return le.coerced_requests(spark.sql(_FORMS, rows=sm.requests(spark, d)))


@query(
    "C09_unexpected_columns",
    """SELECT lead_row, 'email' AS field, 'forbidden_pii' AS rule FROM lead_rows WHERE email <> '' UNION ALL
       SELECT lead_row, 'phone', 'forbidden_pii' FROM lead_rows WHERE phone IS NOT NULL UNION ALL
       SELECT lead_row, 'colour', 'unknown_field' FROM lead_rows WHERE status = 'ok'""",
)
def unexpected_columns(spark, d):
    """Rows that fill a column the request layout does not know."""
    rows = sm.leads(spark, d).select(
        "lead_row", F.nullif("email", F.lit("")).alias("email"), "phone",
        F.when(F.col("status") == "ok", "blue").alias("colour"),
    )
    found = le.unexpected_columns(rows.drop("lead_row"), fixed.REQUEST_FIELDS, ["email", "phone", "name"])
    filled = F.array_compact(
        F.array(
            *[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"))) for n, r in found]
        )
    )
    return rows.select("lead_row", F.explode(filled).alias("e")).select("lead_row", "e.*")


@query(
    "C09_unexpected_fields",
    """SELECT lead_row, 'property.colour' AS field, 'unknown_field' AS rule FROM lead_rows WHERE status = 'ok' UNION ALL
       SELECT lead_row, 'acquisition.phone', 'forbidden_pii' FROM lead_rows WHERE phone IS NOT NULL""",
)
def unexpected_fields(spark, d):
    """Rows that fill a field inside a struct that the lead layout does not know."""
    rows = sm.leads(spark, d).select(
        "lead_row", "kind", F.struct("surface", F.when(F.col("status") == "ok", "blue").alias("colour")).alias("property"),
        F.struct(F.lit("x").alias("source"), "phone").alias("acquisition"),
    )
    found = le.unexpected_fields(rows.drop("lead_row"), fixed.LEAD_LAYOUT, ["email", "phone", "name"])
    filled = F.array_compact(
        F.array(*[F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("field"), F.lit(r).alias("rule"))) for n, r in found])
    )
    return rows.select("lead_row", F.explode(filled).alias("e")).select("lead_row", "e.*")


_BUSY = """SELECT date_trunc('month', CAST(ts AS TIMESTAMP)) AS ts, user_id % 10 AS client FROM {events}"""


@query(
    "T04_scraping_days_default",
    f"""SELECT CAST(ts AS DATE)::VARCHAR AS day, count(*) AS requests, count(DISTINCT client) AS clients FROM ({_BUSY.format(events='events')})
        GROUP BY 1 HAVING count(*) > {fixed.SCRAPING_REQUESTS_PER_DAY} AND count(DISTINCT client) < {fixed.SCRAPING_MAX_CLIENTS}""",
)
def scraping_days_default(spark, d):
    """The settings' own limits, with every call of a month on its first day."""
    return le.scraping_days(sm.on_spark(spark, d, _BUSY)).withColumn("day", F.col("day").cast("string"))
