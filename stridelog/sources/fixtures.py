"""The three input tables derived from the generated ``events`` and ``customer`` tables.

Used by the registered queries, the tests and the benchmark. Every source row is used: each
event becomes a page view or a tracked event, each customer one or two user snapshots. User
days are spread over four months and squeezed into two hours around the local midnight, so
that months, gaps, cohorts and sessions all have something to show. ``FIXTURES.md`` has the
rules in prose.
"""

from __future__ import annotations

import tempfile
from dataclasses import replace
from datetime import date, datetime
from hashlib import sha256
from uuid import uuid4

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.domains import update_domains, user_domains
from .layout import DAY_COLUMN, write_domains, write_events
from .state import Stored, UsageState
from .tables import Tables

_BASE = {
    "event_id": "event_id",
    "user_id": "CAST(user_id AS STRING)",
    "user_key": "user_id",
    "event_type": "event_type",
    "segment": "c_mktsegment",
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
    "day_no": "datediff(to_date(ts), DATE '1970-01-01')",
    "day_us": """
        unix_timestamp(ts) % 86400 * 1000000
            + CAST(extract(SECOND FROM ts) * 1000000 AS BIGINT) % 1000000""",
    "slot": "(user_id + day(ts)) % 4",
}

_SHIFT = """
    CASE user_key % 5
        WHEN 0 THEN IF(slot < 2, 0, 3)
        WHEN 1 THEN slot % 3
        WHEN 2 THEN 0
        WHEN 3 THEN 1 + slot % 3
        ELSE slot
    END
"""

_DAY = """
    CASE
        WHEN segment = 'MACHINERY' AND shift = 3 THEN 19736
        WHEN user_key % 7 = 0 THEN 19723 + (day_no - 19723) DIV 5 * 5
        ELSE day_no
    END
"""

_TIMESTAMP = """
    TIMESTAMP_NTZ '1970-01-01 00:00:00'
        + INTERVAL '1' DAY * (day + 30 * shift)
        + IF(segment = 'MACHINERY' AND shift = 3, INTERVAL '36000' SECOND, INTERVAL '63000' SECOND)
        + INTERVAL '0.000001' SECOND * (day_us DIV 12)
"""

_PAGE_NAMES = (
    "'discovery','home','asset_profile','overview','glossary','term','saved_query','insights',"
    "'monitor','reverse-metadata-sidebar','users','workflows-home','marketplace','inbox',"
    "'unmapped_page',CAST(NULL AS STRING)"
)

_NOISE_NAMES = (
    "'api_error_emit','workflow_run_finished','web_vital_metric_lcp_track',CAST(NULL AS STRING)"
)

_EVENT_NAMES = (
    "'discovery_search_results','atlan_ai_conversation_prompt_submitted','insights_query_run',"
    "'governance_term_updated','gtc_tree_create_term','lineage_expanded','chrome_reverse_opened',"
    "'discovery_metadata_edit','main_navigation_button_clicked','products_home_opened'"
)

_PAGES = {
    "user_id": "user_id",
    "timestamp": "timestamp",
    "domain": """
        CASE
            WHEN k % 25 = 24 OR user_key % 50 = 49 THEN NULL
            WHEN k = 0 THEN 'household.example.com'
            ELSE lower(segment) || '.example.com'
        END""",
    "name": f"element_at(array({_PAGE_NAMES}), k % 16 + 1)",
    "tab": "element_at(array(CAST(NULL AS STRING), 'overview', 'columns'), k % 3 + 1)",
    "connector_name": """
        element_at(array(CAST(NULL AS STRING), 'warehouse', 'bi', 'transform'), k % 4 + 1)""",
    "type_name": "IF(k % 2 = 0, 'Table', 'Column')",
    "asset_guid": "'g' || event_id % 50",
    "email": "IF(k % 20 = 0, 'u' || user_id || '@mail.example', NULL)",
    "session_uuid": "IF(k % 30 = 0, 's' || event_id, NULL)",
    "context_actions_amplitude_session_id": "IF(k % 10 = 0, 'a' || event_id, NULL)",
}

_TRACKS = {
    "user_id": "user_id",
    "timestamp": "timestamp",
    "event_text": f"""
        IF(event_type = 'error',
           element_at(array({_NOISE_NAMES}), k % 4 + 1),
           element_at(array({_EVENT_NAMES}), k % 10 + 1))""",
    "context_actions_amplitude_session_id": "IF(k % 10 = 0, 'a' || event_id, NULL)",
}

# Customers with a key divisible by three are known under an id that never shows up in the
# activity, so part of the users has no match, as in real data.
_USERS = {
    "id": "IF(c_custkey % 3 = 0, 'anon-' || c_custkey, CAST(c_custkey AS STRING))",
    "email": """
        CASE c_custkey % 10
            WHEN 9 THEN NULL
            WHEN 5 THEN 'u' || c_custkey || '.' || n || '@mail.example'
            ELSE 'u' || c_custkey || '@mail.example'
        END""",
    "username": "'user' || c_custkey",
    "domain": "lower(c_mktsegment) || '.example.com'",
    "role": """
        element_at(array('admin', 'member', 'guest', CAST(NULL AS STRING)), c_nationkey % 4 + 1)""",
    "license_type": "IF(c_custkey % 3 = 1, 'full', 'viewer')",
    "job_role": """
        element_at(array('engineer', 'analyst', 'steward', CAST(NULL AS STRING)),
                   CAST(c_custkey % 4 + 1 AS INT))""",
    "personas": "IF(n = 1, 'default', NULL)",
    "plan": "'standard'",
    "salesforce_account_id": "'acct' || c_nationkey",
    "session_uuid": "IF(c_custkey % 5 = 0, NULL, 's' || c_custkey || '-' || n)",
    "created_at": """
        TIMESTAMP_NTZ '2024-01-01 00:00:00' + INTERVAL '1' DAY
            * (n + IF(c_mktsegment = 'FURNITURE', c_custkey % 20, 7 * c_custkey % 118))""",
    "tenant_created_at": "TIMESTAMP_NTZ '2023-01-01 00:00:00'",
    "received_at": """
        TIMESTAMP_NTZ '2024-04-01 00:00:00' + INTERVAL '1' DAY * (c_custkey % 28 + n)""",
}


def fixture_tables(spark: SparkSession, sf_dir: str, shuffled: bool = False) -> Tables:
    """Derive the input tables from ``{sf_dir}/events.parquet`` and ``customer.parquet``.

    ``shuffled``: events and customers meet by a shuffle, so no customers pass the driver.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    activity = _activity(events, customer.hint("merge") if shuffled else customer)
    is_page = F.col("event_type").isin("view", "purchase")
    snapshots = customer.withColumn("n", F.explode(F.expr("sequence(0L, c_custkey % 2)")))
    return Tables(
        pages=_project(activity.filter(is_page), _PAGES),
        tracks=_project(activity.filter(~is_page), _TRACKS),
        users=_project(snapshots, _USERS),
    )


#: The maintained lookup is built from the page views before this instant and updated from the
#: rest.
LOOKUP_SINCE = datetime(2024, 3, 1)


def derived_fixture(spark: SparkSession, sf_dir: str) -> Tables:
    """The derived tables with the lookup that results from one update."""
    derived = fixture_tables(spark, sf_dir)
    new = F.col("timestamp") >= F.lit(LOOKUP_SINCE).cast("timestamp_ntz")
    lookup = update_domains(user_domains(derived.pages.filter(~new)), derived.pages.filter(new))
    return replace(derived, domains=lookup)


def prepare_fixture(spark: SparkSession, sf_dir: str) -> None:
    """Write the derived tables to the shared folder named by ``spark.checkpoint.dir``.

    Everything is written below a fresh name first; a marker file, created last and by one writer
    only, then publishes that name. A write that fails or is still running is never read.
    Without a shared folder there is nothing to do: queries derive their input.
    """
    root = _root(spark, sf_dir)
    if root is None or _published(spark, root) is not None:
        return
    name = uuid4().hex
    derived = derived_fixture(spark, sf_dir)
    for table in ("pages", "tracks", "users", "domains"):
        getattr(derived, table).write.parquet(f"{root}/{name}/{table}")
    _publish(spark, root, name)


def fixture(spark: SparkSession, sf_dir: str, domains: bool = False) -> Tables:
    """The input tables, lazily: the published copy if there is one, else derived.

    ``domains`` adds the maintained lookup.
    """
    root = _root(spark, sf_dir)
    name = None if root is None else _published(spark, root)
    if name is not None:
        return Tables.from_parquet(spark, f"{root}/{name}", domains=domains)
    derived = derived_fixture(spark, sf_dir)
    return derived if domains else replace(derived, domains=None)


#: The stored state of the registered queries takes in the days in these loads.
STATE_LOADS = (date(2024, 2, 10), date(2024, 3, 15), date(2024, 12, 31))


def fixture_state(spark: SparkSession, sf_dir: str) -> Stored:
    """The stored state of the input tables, after several loads.

    It is built once per application, below the shared folder. Without one a local session gets a
    temporary folder.
    """
    state = UsageState(spark, f"{_shared_root(spark, sf_dir)}/state")
    tables = _events_by_day(spark, sf_dir)
    for through in STATE_LOADS:
        state.update(tables, through)
    return state.tables()


def _events_by_day(spark: SparkSession, sf_dir: str) -> Tables:
    """The input tables, events by UTC day: what loads read, of which each takes its days only.

    They are derived and written once per application; every load would derive all of them again.
    """
    root = f"{_shared_root(spark, sf_dir)}/events"
    copy = _root(spark, sf_dir)
    if _published(spark, copy) is None:
        source = fixture_tables(spark, sf_dir, shuffled=True)
    else:
        source = fixture(spark, sf_dir)
    if _published(spark, root) is None:
        name = uuid4().hex
        write_events(source.pages.select(*_PAGES), f"{root}/{name}/pages")
        write_events(source.tracks.select(*_TRACKS), f"{root}/{name}/tracks")
        _publish(spark, root, name)
    folder = f"{root}/{_published(spark, root)}"
    pages = _read_events(spark, source.pages.select(*_PAGES), f"{folder}/pages")
    tracks = _read_events(spark, source.tracks.select(*_TRACKS), f"{folder}/tracks")
    return replace(source, pages=pages, tracks=tracks, day_column=DAY_COLUMN)


def _read_events(spark: SparkSession, like: DataFrame, path: str) -> DataFrame:
    """Events by day with the columns of ``like``; none if none were written."""
    return spark.read.schema(like.schema.add(DAY_COLUMN, "date")).parquet(path)


def fixture_days(spark: SparkSession, sf_dir: str) -> Tables:
    """The input tables in the layout for production: events by UTC day, and the lookup.

    They are written once per application, like the stored state.
    """
    root = f"{_shared_root(spark, sf_dir)}/days"
    if _published(spark, root) is None:
        name, source = uuid4().hex, fixture(spark, sf_dir, domains=True)
        write_events(source.pages, f"{root}/{name}/pages", ("domain", "user_id"))
        write_events(source.tracks, f"{root}/{name}/tracks")
        write_domains(source.domains, f"{root}/{name}/domains")
        source.users.write.parquet(f"{root}/{name}/users")
        _publish(spark, root, name)
    folder = f"{root}/{_published(spark, root)}"
    return Tables.from_parquet(spark, folder, day_column=DAY_COLUMN, domains=True)


def _shared_root(spark: SparkSession, sf_dir: str) -> str:
    """``_root``, below a temporary folder if a local session has no shared one."""
    if _root(spark, sf_dir) is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder shared by the cluster")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stridelog-"))
    return _root(spark, sf_dir)


def _root(spark: SparkSession, sf_dir: str) -> str | None:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return None
    app = spark.sparkContext.applicationId
    return f"{base}/stridelog/{app}/{sha256(sf_dir.encode()).hexdigest()[:12]}"


def _marker(spark: SparkSession, root: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _publish(spark: SparkSession, root: str, name: str) -> None:
    """Create the marker that names the copy to read; the first writer wins."""
    files, marker = _marker(spark, root)
    try:
        out = files.create(marker, False)
    except Py4JJavaError:
        if _published(spark, root) is None:
            raise
        return
    out.write(bytearray(name.encode()))
    out.close()


def _published(spark: SparkSession, root: str) -> str | None:
    files, marker = _marker(spark, root)
    if not files.exists(marker):
        return None
    source = files.open(marker)
    name = bytes(source.readAllBytes()).decode()
    source.close()
    return name if len(name) == 32 else None


def _activity(events: DataFrame, customer: DataFrame) -> DataFrame:
    segments = customer.select("c_custkey", "c_mktsegment")
    base = _project(events.join(segments, events.user_id == segments.c_custkey, "left"), _BASE)
    capped = F.when(
        (F.col("segment") == "FURNITURE") & (F.col("user_key") % 2 == 0),
        F.least("shift", F.lit(2)),
    ).otherwise(F.col("shift"))
    return (
        base.withColumn("shift", F.expr(_SHIFT))
        .withColumn("shift", capped)
        .withColumn("day", F.expr(_DAY))
        .withColumn("timestamp", F.expr(_TIMESTAMP))
    )


def _project(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    return rows.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])
