"""The same results as ``lake`` in plain SQL."""

_DAY = "date '1970-01-01'"


def murmur(source: str, key: str) -> str:
    """CTEs ``m0`` to ``hashed``: columns of ``source`` and ``h``, the hash of the long ``key``.

    One operation per step, in whole numbers wide enough; k is a 32-bit word, h the state.
    """
    steps: list[str] = []

    def step(**new: str) -> None:
        prev = f"m{len(steps) - 1}" if steps else f"({source})"
        kept = [c for c in new if steps and c in ("h", "k")]
        base = f"* EXCLUDE ({', '.join(kept)})" if kept else "*"
        steps.append(f"m{len(steps)} AS (SELECT {base}, {', '.join(f'{e} AS {c}' for c, e in new.items())} FROM {prev})")

    rotl = lambda x, r: f"(({x} * {2**r}::HUGEINT) % 4294967296 + {x} // {2 ** (32 - r)})"
    times = lambda x, m: f"(({x}::HUGEINT * {m}) % 4294967296)"
    low, high = f"((({key} % 4294967296) + 4294967296) % 4294967296)", f"(({key} >> 32) & 4294967295)"
    for i, word in enumerate((low, high)):
        step(**({"h": "0::BIGINT", "k": f"{word}::BIGINT"} if i == 0 else {"k": f"{word}::BIGINT"}))
        step(k=times("k", 3432918353))
        step(k=rotl("k", 15))
        step(k=times("k", 461845907))
        step(h="xor(h::BIGINT, k::BIGINT)")
        step(h=rotl("h::HUGEINT", 13))
        step(h="((h::HUGEINT * 5 + 3864292196) % 4294967296)")
    step(h="xor(h::BIGINT, 8::BIGINT)")
    for shift, factor in ((16, 2246822507), (13, 3266489909), (16, None)):
        step(h=f"xor(h::BIGINT, h::BIGINT >> {shift})")
        if factor:
            step(h=times("h", factor))
    steps.append(f"hashed AS (SELECT *, (h & 2147483647)::BIGINT AS bits FROM m{len(steps) - 1})")
    return ",\n".join(steps)


def _count(expression: str, source: str) -> str:
    return f"SELECT {expression} AS p, CAST(count(*) AS BIGINT) AS record_count FROM {source} GROUP BY 1"


def _bucket(source: str, key: str, n: int) -> str:
    rows = f"SELECT CAST({key} AS BIGINT) AS key FROM {source} WHERE {key} IS NOT NULL"
    return f"WITH {murmur(rows, 'key')} SELECT CAST(bits % {n} AS INT) AS p, count(*) AS record_count FROM hashed GROUP BY 1"


_ORDER_COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
_DECIMAL = "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders"

_EVENTS = f"""rows AS (
  SELECT event_id AS id, ts AS t FROM events
  UNION ALL VALUES (-1, TIMESTAMP '1969-12-31 23:00:00'), (-2, TIMESTAMP '2022-11-01 23:30:00'), (-3, NULL), (-4, TIMESTAMP '1900-03-01 00:00:00.000001'))"""

TRANSFORMS = f"""WITH {_EVENTS}, {murmur('SELECT * FROM rows', 'id')}
SELECT id, CAST(year(t) - 1970 AS INT) AS t_year, CAST(12 * (year(t) - 1970) + month(t) - 1 AS INT) AS t_month,
  CAST(datediff('day', {_DAY}, CAST(t AS DATE)) AS INT) AS t_day,
  CAST((epoch_us(t) - ((epoch_us(t) % 3600000000) + 3600000000) % 3600000000) // 3600000000 AS INT) AS t_hour,
  CAST(year(t) - 1970 AS INT) AS d_year, CAST(12 * (year(t) - 1970) + month(t) - 1 AS INT) AS d_month,
  CAST(datediff('day', {_DAY}, CAST(t AS DATE)) AS INT) AS d_day,
  id - ((id % 10) + 10) % 10 AS id_trunc, CAST(bits % 32 AS INT) AS id_bucket, CAST(NULL AS INT) AS id_void
FROM hashed"""

ORACLE_SQL = {
    "append_identity": "SELECT * FROM customer",
    "append_year": "SELECT * FROM orders",
    "append_month": "SELECT * FROM lineitem",
    "append_day": "SELECT * FROM events",
    "append_hour": "SELECT * FROM events",
    "append_void": "SELECT * FROM nation",
    "append_truncate_int": "SELECT * FROM part",
    "append_truncate_long": "SELECT * FROM orders",
    "append_truncate_string": "SELECT * FROM part",
    "append_truncate_decimal": _DECIMAL,
    "append_bucket_int": "SELECT * FROM part",
    "append_bucket_long": "SELECT * FROM orders",
    "append_bucket_string": "SELECT * FROM part",
    "append_bucket_date": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders",
    "append_bucket_timestamp": "SELECT * FROM orders",
    "append_bucket_decimal": _DECIMAL,
    "append_several": "SELECT * FROM orders",
    "partitions_identity": _count("c_mktsegment", "customer"),
    "partitions_year": _count("CAST(year(o_orderdate) - 1970 AS INT)", "orders"),
    "partitions_month": _count("CAST(12 * (year(l_shipdate) - 1970) + month(l_shipdate) - 1 AS INT)", "lineitem"),
    "partitions_day": _count(f"CAST(datediff('day', {_DAY}, CAST(ts AS DATE)) AS INT)", "events"),
    "partitions_hour": _count("CAST(epoch_us(ts) // 3600000000 AS INT)", "events"),
    "partitions_truncate_int": _count("CAST(p_size - p_size % 10 AS INT)", "part"),
    "partitions_truncate_long": _count("o_orderkey - o_orderkey % 5000", "orders"),
    "partitions_truncate_string": _count("substr(p_brand, 1, 7)", "part"),
    "partitions_bucket_int": _bucket("part", "p_size", 8),
    "partitions_bucket_long": _bucket("orders", "o_custkey", 16),
    "partitions_bucket_date": _bucket("orders", f"datediff('day', {_DAY}, CAST(o_orderdate AS DATE))", 8),
    "partitions_bucket_timestamp": _bucket("orders", "epoch_us(o_orderdate)", 8),
    "scan_all": "SELECT * FROM nation",
    "scan_projection": "SELECT o_orderkey, o_totalprice FROM orders",
    "scan_nested": "SELECT vec_id, label, CAST(len(embedding) AS INT) AS dim FROM embeddings",
    "scan_partition_value": "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'",
    "scan_time_travel": "SELECT * FROM orders WHERE o_orderpriority < '3'",
    "scan_tag": "SELECT * FROM orders WHERE o_orderpriority < '3'",
    "scan_resume": """SELECT * FROM orders WHERE o_orderpriority >= '3'
        AND o_orderkey <> (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority LIKE '3%')""",
    "predicate_pruned_scan": """SELECT l_orderkey, l_shipdate, l_quantity FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1997-06-15' AND l_shipdate < TIMESTAMP '1997-09-01'""",
    "append_precomputed_partition": "SELECT * FROM orders",
    "append_sorted": "SELECT * FROM orders",
    "append_overwrite": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "append_many_compacted": "SELECT *, CAST(1 AS BIGINT) AS files FROM orders",
    "stream_append": "SELECT * FROM orders",
    "delta_insert_overwrites": "SELECT * REPLACE (o_totalprice * 2 AS o_totalprice) FROM orders",
    "delta_delete_same_call": "SELECT * FROM orders WHERE o_orderpriority <> '1-URGENT'",
    "delta_delete_prior_snapshot": "SELECT * FROM orders WHERE o_orderstatus <> 'O'",
    "delta_partitioned": """SELECT * REPLACE (CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE o_totalprice END AS o_totalprice) FROM orders
        WHERE o_orderstatus <> 'F' OR o_orderpriority LIKE '2%'""",
    "delta_upsert": "SELECT * REPLACE (CASE WHEN o_orderpriority = '5-LOW' THEN 0.0 ELSE o_totalprice END AS o_totalprice) FROM orders",
    "delta_compacted": "SELECT *, CAST(0 AS INT) AS delete_files FROM orders WHERE o_orderstatus <> 'O'",
    "equality_delete_read": "SELECT * FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')",
    "position_delete_read": "SELECT * FROM lineitem WHERE NOT l_quantity > 25",
    "snapshot_summary": """WITH c AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) AS n FROM orders)
        SELECT CAST(1 AS BIGINT) AS snapshot_id, CAST(NULL AS BIGINT) AS parent_id, CAST(1 AS BIGINT) AS sequence_number, 'append' AS operation,
          f AS added_records, f AS total_records, CAST(0 AS BIGINT) AS added_equality_deletes, CAST(0 AS BIGINT) AS total_equality_deletes FROM c
        UNION ALL SELECT 2, 1, 2, 'append', n - f, n, 0, 0 FROM c UNION ALL SELECT 3, 2, 3, 'delete', 0, n, f, f FROM c""",
    "files_null_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS records, count(*) - count({c}) AS nulls FROM documents"
        for c in ("doc_id", "text", "lang", "question_id", "score", "duplicate_of", "created_at")
    ),
    "entries_by_status": """SELECT CAST(1 AS BIGINT) AS sequence_number, count(*) AS records FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 2, count(*) FROM orders WHERE o_orderstatus = 'O'""",
    "manifest_rows": """SELECT CAST(1 AS BIGINT) AS sequence_number, count(*) AS added_rows, CAST(0 AS BIGINT) AS deleted_rows FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 2, count(*), 0 FROM orders WHERE o_orderstatus = 'O'""",
    "schema_rename_add": "SELECT n_nationkey, n_name AS country, n_regionkey, CAST(NULL AS VARCHAR) AS note, CAST(7 AS INT) AS rank FROM nation",
    "schema_drop_widen": "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CAST(NULL AS VARCHAR) AS p_brand FROM part",
    "spec_evolution": "SELECT * FROM orders",
    "rollback": "SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "branch_append": """SELECT 'F' AS o_orderstatus, count(*) AS n, 'main' AS branch FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT o_orderstatus, count(*), 'audit' FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1""",
    "transform_columns": TRANSFORMS,
    "over_scan_join_agg": """SELECT c_mktsegment, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_order
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "over_scan_window": """SELECT o_orderkey, o_custkey, o_totalprice, CAST(rn AS INT) AS rn FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2""",
    "over_scan_set_ops": """SELECT o_custkey, 'both' AS side FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
        UNION ALL SELECT o_custkey, 'only_f' FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""",
    "over_scan_rollup": """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS qty
        FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
}
