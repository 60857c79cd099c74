"""Plain SQL for the quality queries that SQL can express."""

_NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def _whole(c: str) -> str:
    return f"CASE WHEN regexp_matches(trim({c}), {_NUM}) THEN CAST(CAST(trunc(CAST(trim({c}) AS DOUBLE)) AS BIGINT) AS VARCHAR) END"


def _name(c: str) -> str:
    return f"nullif(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), '')"


_ORPHANS = f"""
WITH parents AS (
  SELECT 'users' AS ref, {_whole("user_id")} AS k, registered_at AS s FROM users
  UNION ALL SELECT 'menu_items', {_whole("item_id")}, coalesce(CAST(nullif(available_from, '') AS TIMESTAMP), TIMESTAMP '0001-01-01') FROM menu_items
  UNION ALL SELECT 'stores', {_name("store_name")}, TIMESTAMP '0001-01-01' FROM stores),
gone AS (
  SELECT ref_table AS ref, CASE WHEN ref_table = 'stores' THEN {_name("ref_key")} ELSE {_whole("ref_key")} END AS k, deleted_at AS d FROM key_deletions),
lives AS (
  SELECT p.ref, p.k, p.s, min(g.d) AS e FROM (SELECT DISTINCT * FROM parents) p LEFT JOIN gone g ON p.ref = g.ref AND p.k = g.k AND g.d > p.s WHERE p.k IS NOT NULL GROUP BY 1, 2, 3),
r AS (
  SELECT 'transactions' AS table_name, row_id AS record_id, 'users' AS ref, {_whole("user_id")} AS k, created_at AS t FROM transactions
  UNION ALL SELECT 'transaction_items', row_id, 'menu_items', {_whole("item_id")}, created_at FROM transaction_items
  UNION ALL SELECT 'q4_candidates', candidate_id, 'stores', {_name("store_name")}, computed_at FROM q4_candidates),
orphan AS (
  SELECT r.* FROM r WHERE k IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lives l WHERE l.ref = r.ref AND l.k = r.k AND l.s <= r.t AND (l.e IS NULL OR r.t < l.e)))
"""

# The columns of the profiled tables: text, numbers and times.
_PROFILED = {
    "transactions": ("transaction_id store_id payment_method_id voucher_id user_id", "row_id original_amount discount_applied final_amount", "created_at loaded_at"),
    "transaction_items": ("transaction_id item_id", "row_id quantity unit_price subtotal", "created_at"),
    "q2b_profits": ("year_month_created_at item_name", "profit_sum", ""),
}


def _number(c: str, kind: int) -> str:
    return (f"CASE WHEN regexp_matches(trim({c}), {_NUM}) THEN CAST(trim({c}) AS DOUBLE) END", f"CAST({c} AS DOUBLE)", f"floor(epoch({c}))")[kind]


def _profile(table: str, c: str, kind: int) -> str:
    number = _number(c, kind)
    value = f"nullif({c}, '')" if kind == 0 else c
    bad = f"count(*) FILTER ({c} <> '' AND NOT regexp_full_match({c}, '0|[1-9][0-9]*'))" if c == "user_id" else "0"
    return f"SELECT '{table}' AS table_name, '{c}' AS column_name, load_id, count(*) AS n_rows, count(*) - count({value}) AS n_null, count(DISTINCT {value}) AS n_distinct, CAST({bad} AS BIGINT) AS n_violations, min({number}) AS min_value, max({number}) AS max_value FROM {table} GROUP BY load_id"


def _moments(table: str, c: str, kind: int) -> str:
    """Mean, deviation and third and fourth moments of one column per load, about the mean of the load."""
    number = _number(c, kind)
    digits = ", ".join(f"CASE WHEN {x} IS NOT NULL THEN printf('%.6e', {x}) END AS {x}" for x in ("mean", "sd", "skew", "kurt"))
    return f"""SELECT '{table}' AS table_name, '{c}' AS column_name, load_id, s0, {digits} FROM (
        SELECT load_id, count(x) AS s0, any_value(m) AS mean, sqrt(avg((x - m) ** 2)) AS sd,
            avg((x - m) ** 3) / nullif(avg((x - m) ** 2) ** 1.5, 0) AS skew, avg((x - m) ** 4) / nullif(avg((x - m) ** 2) ** 2, 0) AS kurt
        FROM (SELECT load_id, x, avg(x) OVER (PARTITION BY load_id) AS m FROM (SELECT load_id, {number} AS x FROM {table})) GROUP BY load_id)"""


def _sums(table: str, c: str, kind: int) -> str:
    """Exact sums of one column, its squares and cubes per load, as whole numbers of hundredths in 128 bits."""
    k = f"CAST(round({_number(c, kind)} * 100) AS HUGEINT)" if kind == 0 or c == "profit_sum" else f"CAST({c} * 100 AS HUGEINT)"
    value = f"nullif({c}, '')" if kind == 0 else c
    text = ", ".join(f"CASE WHEN s{i} IS NOT NULL THEN CASE WHEN s{i} < 0 THEN '-' ELSE '' END || CAST(abs(s{i}) // {100**i} AS VARCHAR) || '.' || lpad(CAST(abs(s{i}) % {100**i} * {10 ** (6 - 2 * i)} AS VARCHAR), 6, '0') END AS s{i}" for i in (1, 2, 3))
    return f"""SELECT '{table}' AS table_name, '{c}' AS column_name, load_id, n_rows, n_null, s0, {text} FROM (
        SELECT load_id, count(*) AS n_rows, count(*) - count(v) AS n_null, count(k) AS s0, sum(k) AS s1, sum(k * k) AS s2, sum(k * k * k) AS s3 FROM (SELECT load_id, {value} AS v, {k} AS k FROM {table}) GROUP BY load_id)"""


# The columns whose loads are compared, in the kinds of the profiled tables.
_WATCHED = {"transactions": (("user_id", 0), ("store_id", 0), ("payment_method_id", 0), ("voucher_id", 0), ("discount_applied", 1), ("final_amount", 1)), "transaction_items": (("quantity", 1),), "q2b_profits": (("profit_sum", 1),)}

# The columns of delimited records, in order, and what their values hold.
_RECORDS = {
    "transactions": "transaction_id store_id payment_method_id voucher_id user_id original_amount discount_applied final_amount created_at",
    "transaction_items": "transaction_id item_id quantity unit_price subtotal created_at",
    "users": "user_id gender birthdate registered_at",
    "stores": "store_id store_name street postal_code city state latitude longitude",
    "menu_items": "item_id item_name category price is_seasonal available_from available_to",
}
_DECIMAL = "-?([0-9]+[.]?[0-9]*|[.][0-9]+)"
_HOLDS = (
    {"transaction_id": "regexp_full_match({v}, '[0-9a-fA-F]{{8}}-([0-9a-fA-F]{{4}}-){{3}}[0-9a-fA-F]{{12}}')", "user_id": "regexp_full_match({v}, '[0-9]+([.]0)?')", "is_seasonal": "lower({v}) IN ('true', 'false')"}
    | {c: "regexp_full_match({v}, '[0-9]+')" for c in ("store_id", "payment_method_id", "voucher_id", "item_id", "quantity")}
    | {c: f"regexp_full_match({{v}}, '{_DECIMAL}')" for c in ("original_amount", "discount_applied", "final_amount", "unit_price", "subtotal", "price")}
    | {c: f"regexp_full_match({{v}}, '{_DECIMAL}') AND abs(TRY_CAST({{v}} AS DOUBLE)) <= {b}" for c, b in (("latitude", 90), ("longitude", 180))}
    | {c: "regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}') AND substr({v}, 12, 2) < '24' AND TRY_CAST({v} AS TIMESTAMP) IS NOT NULL" for c in ("created_at", "registered_at")}
    | {c: "regexp_full_match({v}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST({v} AS DATE) IS NOT NULL" for c in ("birthdate", "available_from", "available_to")}
)
_MAY_BE_EMPTY = {"voucher_id", "gender", "available_from", "available_to"}


def _valid(table: str) -> str:
    out = []
    for i, c in enumerate(_RECORDS[table].split(), 1):
        v = f"trim(f[{i}], ' ' || chr(9) || chr(10) || chr(13))"
        holds = f"({_HOLDS[c].format(v=v)})" if c in _HOLDS else "true"
        empty = c in _MAY_BE_EMPTY or (table, c) == ("transactions", "user_id")
        out.append(f"coalesce(CASE WHEN {v} = '' THEN {str(empty).lower()} ELSE {holds} END, false)")
    return " AND ".join(out)


_FIELD = '"(?:[^"]|"")*"|[^",]*'
_PARSED = f"""
WITH lines AS (SELECT raw_id, data_type, columns_have, CASE WHEN right(raw_line, 1) = chr(13) THEN left(raw_line, length(raw_line) - 1) ELSE raw_line END AS line FROM raw_rows WHERE NOT regexp_full_match(raw_line, '\\s*')),
quoted AS (SELECT *, regexp_full_match(line, '(?:{_FIELD})(?:,(?:{_FIELD}))*') AS ok FROM lines),
fields AS (SELECT *, CASE WHEN ok THEN list_transform(regexp_extract_all(line || ',', '({_FIELD}),', 1), lambda x: CASE WHEN left(x, 1) = '"' THEN replace(substr(x, 2, length(x) - 2), '""', '"') ELSE x END) END AS f FROM quoted),
parsed AS (SELECT raw_id, data_type, f, CASE WHEN NOT ok THEN 'quoting' WHEN len(f) <> columns_have THEN 'column_count' WHEN NOT (CASE data_type {" ".join(f"WHEN '{t}' THEN {_valid(t)}" for t in _RECORDS)} ELSE true END) THEN 'invalid_value' END AS reason FROM fields)
"""

SQL = {
    "p5_found": _PARSED + "SELECT raw_id, reason FROM parsed WHERE reason IS NOT NULL",
    "p5_loaded": _PARSED + "SELECT raw_id, data_type, CAST(to_json(f) AS VARCHAR) AS fields FROM parsed WHERE reason IS NULL",
    "p1_moments": " UNION ALL ".join(_moments(t, c, k) for t, cs in _WATCHED.items() for c, k in cs),
    "p1_power_sums": " UNION ALL ".join(_sums(t, c, k) for t, cs in _WATCHED.items() for c, k in cs),
    "p1_profile": " UNION ALL ".join(_profile(t, c, k) for t, kinds in _PROFILED.items() for k, cs in enumerate(kinds) for c in cs.split()),
    "p2_found": _ORPHANS + "SELECT DISTINCT table_name, record_id, strftime(t, '%Y-%m') AS period FROM orphan",
    "p2_report": _ORPHANS + "SELECT table_name, strftime(t, '%Y-%m') AS period, count(*) AS orphan_rows, count(DISTINCT k) AS orphan_keys FROM orphan GROUP BY 1, 2",
    "p3_found": """SELECT delivery_id FROM (
        SELECT delivery_id, row_number() OVER (PARTITION BY request_id, data_type, position ORDER BY received_at NULLS LAST, delivery_id) AS i
        FROM receiver_messages WHERE position IS NOT NULL AND request_id IS NOT NULL AND data_type IS NOT NULL) WHERE i > 1""",
    "p3_kept": """SELECT delivery_id, request_id, data_type, position, payload FROM receiver_messages WHERE position IS NULL OR request_id IS NULL OR data_type IS NULL OR delivery_id IN (
        SELECT first(delivery_id ORDER BY received_at NULLS LAST, delivery_id) FROM receiver_messages
        WHERE position IS NOT NULL AND request_id IS NOT NULL AND data_type IS NOT NULL GROUP BY request_id, data_type, position)""",
}
