"""The same queries as SQL over the same tables, for DuckDB.

They state the rules independently of the Spark code: the views below are the
domain tables, and every query is a plain SELECT over them.
"""

AS_OF = "DATE '1999-06-01'"

_VIEWS = {
    "countries": """
        SELECT n_nationkey AS id, n_name AS name,
               'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso_code,
               CAST(n_nationkey * 2 - 20 AS DECIMAL(9,6)) AS latitude,
               CAST(n_nationkey * 5 - 60 AS DECIMAL(9,6)) AS longitude,
               n_regionkey <> 4 AS in_scope
        FROM nation""",
    "clubs": """
        SELECT s_suppkey * 2 AS id, s_name AS name, s_nationkey AS country_id, n_regionkey AS league_id
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL
        SELECT c_custkey * 2 + 1, c_name, c_nationkey,
               CASE WHEN c_mktsegment <> 'MACHINERY' THEN n_regionkey END
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "players": """
        SELECT p_partkey AS id, p_name AS name,
               DATE '1965-01-01' + CAST((p_partkey * 37) % 5000 AS INTEGER) AS date_of_birth,
               p_type AS position,
               CASE WHEN p_size % 10 = 0 THEN NULL
                    WHEN p_type = 'PROMO' THEN 'GK'
                    WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'DEF'
                    WHEN p_type = 'MEDIUM' THEN 'MID'
                    WHEN p_type IN ('SMALL', 'LARGE') THEN 'FWD' END AS position_group,
               p_brand AS nationality, '/p/' || p_partkey AS transfermarkt_url, p_size
        FROM part""",
    "moves": """
        SELECT *, CASE WHEN l_linestatus = 'O' THEN l_suppkey * 2 ELSE o_custkey * 2 + 1 END AS from_club_id,
               CASE WHEN l_linestatus = 'O' THEN o_custkey * 2 + 1 ELSE l_suppkey * 2 END AS to_club_id,
               CASE WHEN month(o_orderdate) < 7 THEN year(o_orderdate) - 1 ELSE year(o_orderdate) END AS start_year
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "transfers": """
        SELECT substr(sha256(player_id || ':' || coalesce(CAST(transfer_date AS VARCHAR), 'unknown')
                      || ':' || from_club_id || ':' || to_club_id), 1, 16) AS id, *,
               CASE WHEN transfer_date IS NULL THEN 'Summer ' || start_year
                    WHEN month(transfer_date) BETWEEN 6 AND 12 THEN 'Summer ' || year(transfer_date)
                    ELSE 'Winter ' || year(transfer_date) END AS transfer_window,
               start_year || '-' || (start_year + 1) AS season
        FROM (SELECT l_partkey AS player_id, from_club_id, to_club_id,
                     CASE WHEN l_quantity % 10 = 0 THEN NULL WHEN l_discount = 0 THEN 0
                          ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END AS fee_eur,
                     l_returnflag = 'R' AS fee_is_loan,
                     CASE WHEN l_tax <> 0 THEN CAST(l_shipdate AS DATE) END AS transfer_date,
                     start_year, l_returnflag, l_discount
              FROM moves)""",
    "valuation_rows": """
        SELECT user_id AS player_id, CAST(ts AS DATE) AS valuation_date,
               CAST(trunc(value * 100) AS BIGINT) AS valuation_eur, event_id, event_type
        FROM events""",
    "valuations": """
        SELECT player_id, valuation_date, arg_min(valuation_eur, event_id) AS valuation_eur
        FROM valuation_rows GROUP BY ALL""",
    "full_moves": """
        SELECT t.*, fc.name AS from_club_name, tc.name AS to_club_name,
               fc.country_id AS from_country_id, tc.country_id AS to_country_id,
               p.name AS player_name, p.transfermarkt_url AS player_transfermarkt_url,
               p.position_group, p.date_of_birth,
               CASE WHEN transfer_window LIKE 'Winter%' THEN 1 ELSE 0 END
                 + 2 * CAST(right(transfer_window, 4) AS INTEGER) AS window_order
        FROM transfers t JOIN clubs fc ON t.from_club_id = fc.id JOIN clubs tc ON t.to_club_id = tc.id
             JOIN players p ON t.player_id = p.id""",
    "ranged": """
        SELECT * FROM full_moves WHERE window_order BETWEEN 1996 * 2 AND 1999 * 2 + 1""",
    "filtered": """
        SELECT * FROM ranged
        WHERE fee_eur > 0 AND fee_eur >= 1000000 AND position_group IN ('DEF', 'MID')
          AND date_part('year', age(transfer_date, date_of_birth)) BETWEEN 20 AND 33""",
    "raw_transfers": """
        SELECT CASE WHEN l_quantity = 13 THEN ''
                    WHEN l_quantity = 17 THEN '9' || lpad(CAST(l_partkey AS VARCHAR), 12, '0')
                    ELSE l_partkey || '.0' END AS player_id,
               CASE WHEN l_quantity = 23 THEN 'nan' ELSE CAST(from_club_id AS VARCHAR) END AS from_club_id,
               CASE WHEN l_quantity = 29 THEN '999999999999' ELSE CAST(to_club_id AS VARCHAR) END AS to_club_id,
               CASE WHEN l_tax = 0 THEN '' WHEN l_tax = 0.08 THEN 'soon'
                    WHEN l_tax = 0.07 THEN strftime(CAST(l_shipdate AS DATE), '%b %-d, %Y')
                    WHEN l_tax = 0.06 THEN strftime(CAST(l_shipdate AS DATE), '%m/%d/%Y')
                    WHEN l_tax = 0.05 THEN strftime(CAST(l_shipdate AS DATE), '%Y/%m/%d')
                    ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS transfer_date,
               CASE WHEN l_discount = 0.1 AND l_linenumber = 1 THEN 'NA'
                    WHEN l_linenumber = 2 THEN start_year || '/' || (start_year + 1)
                    ELSE lpad(CAST(start_year % 100 AS VARCHAR), 2, '0') || '/'
                         || lpad(CAST((start_year + 1) % 100 AS VARCHAR), 2, '0') END AS transfer_season,
               CASE l_linenumber
                    WHEN 1 THEN '€' || (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0')
                    WHEN 2 THEN 'Loan fee:€' || quantity || '.5k'
                    WHEN 3 THEN CASE WHEN l_tax > 0.04 THEN 'End of loan' ELSE 'free transfer' END
                    WHEN 4 THEN CASE WHEN l_tax > 0.04 THEN '-' ELSE '?' END
                    WHEN 5 THEN ' €' || quantity || ' Th. '
                    WHEN 6 THEN quantity || ',500,000'
                    ELSE quantity || ',25 mil.' END AS transfer_fee,
               start_year, l_tax, l_shipdate, l_quantity = 31 AS malformed
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
                     CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS quantity FROM moves)""",
    "raw_seasons": """
        SELECT *, regexp_extract(transfer_season, '^([0-9]{2,4})[/-]([0-9]{2,4})', 1) AS first_text,
               regexp_extract(transfer_season, '^([0-9]{2,4})[/-]([0-9]{2,4})', 2) AS last_text
        FROM raw_transfers""",
    "seasons": """
        SELECT *, CASE WHEN length(first_text) = 2 AND TRY_CAST(first_text AS INTEGER) < 80
                            THEN 2000 + TRY_CAST(first_text AS INTEGER)
                       WHEN length(first_text) = 2 THEN 1900 + TRY_CAST(first_text AS INTEGER)
                       ELSE TRY_CAST(first_text AS INTEGER) END AS season_first,
               CASE WHEN length(last_text) = 2 AND TRY_CAST(last_text AS INTEGER) < 80
                            THEN 2000 + TRY_CAST(last_text AS INTEGER)
                       WHEN length(last_text) = 2 THEN 1900 + TRY_CAST(last_text AS INTEGER)
                       ELSE TRY_CAST(last_text AS INTEGER) END AS season_last,
               coalesce(TRY_CAST(transfer_date AS DATE),
                        CAST(try_strptime(transfer_date, ['%m/%d/%Y', '%Y/%m/%d', '%b %-d, %Y']) AS DATE)) AS day
        FROM raw_seasons""",
    "typed": """
        SELECT *, CASE WHEN day IS NULL THEN 'Summer ' || season_first
                       WHEN month(day) >= 6 THEN 'Summer ' || year(day)
                       ELSE 'Winter ' || year(day) END AS transfer_window,
               season_first || '-' || season_last AS season
        FROM seasons""",
    "priced": """
        SELECT *, CASE WHEN low LIKE '%end of loan%' THEN NULL
                       WHEN low LIKE '%loan fee%' AND number <> '' THEN amount
                       WHEN low LIKE '%loan%' OR low LIKE '%free transfer%' OR low = 'free' THEN 0
                       WHEN low IN ('-', '?') THEN NULL
                       ELSE coalesce(amount, CAST(trunc(TRY_CAST(replace(low, ',', '') AS DOUBLE) * 100) AS BIGINT))
                  END AS fee_eur,
               low LIKE '%loan%' AND low NOT LIKE '%end of loan%' AS fee_is_loan,
               low LIKE '%end of loan%' AS fee_excluded
        FROM (SELECT *, CAST(trunc(TRY_CAST(replace(number, ',', '.') AS DOUBLE) * factor * 100) AS BIGINT) AS amount
              FROM (SELECT *, regexp_extract(low, '([0-9.,]+)[ ]*(m|k|th)?', 1) AS number,
                           CASE regexp_extract(low, '([0-9.,]+)[ ]*(m|k|th)?', 2)
                                WHEN 'm' THEN 1000000.0::DOUBLE WHEN 'k' THEN 1000.0::DOUBLE
                                WHEN 'th' THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS factor
                    FROM (SELECT *, lower(trim(transfer_fee)) AS low FROM typed)))""",
    "judged": """
        SELECT r.*, p.id AS player, fc.id AS from_club, tc.id AS to_club,
               CASE WHEN malformed THEN 'malformed_row'
                    WHEN fee_excluded THEN 'excluded_fee'
                    WHEN r.player_id = '' THEN 'missing_player'
                    WHEN r.from_club_id = 'nan' THEN 'missing_club'
                    WHEN r.transfer_window IS NULL OR r.season IS NULL THEN 'no_window_or_season'
                    WHEN p.id IS NULL THEN 'unknown_player'
                    WHEN fc.id IS NULL OR tc.id IS NULL THEN 'unknown_club'
                    WHEN r.transfer_date = 'soon' THEN 'accepted_unread_date'
                    ELSE 'accepted' END AS outcome
        FROM priced r
             LEFT JOIN players p ON p.id = CAST(TRY_CAST(r.player_id AS DOUBLE) AS BIGINT)
             LEFT JOIN clubs fc ON CAST(fc.id AS VARCHAR) = r.from_club_id
             LEFT JOIN clubs tc ON CAST(tc.id AS VARCHAR) = r.to_club_id""",
    "flows_by_window": """
        SELECT fc.country_id AS from_country_id, tc.country_id AS to_country_id, transfer_window,
               CAST(coalesce(sum(fee_eur) FILTER (NOT fee_is_loan), 0) AS BIGINT) AS total_fee_eur,
               count(*) FILTER (NOT fee_is_loan) AS transfer_count,
               count(*) FILTER (fee_is_loan) AS loan_count
        FROM transfers t JOIN clubs fc ON t.from_club_id = fc.id JOIN clubs tc ON t.to_club_id = tc.id
        GROUP BY ALL""",
    "legs": """
        SELECT to_club_id AS club_id, *, TRUE AS buys FROM transfers
        UNION ALL
        SELECT from_club_id AS club_id, *, FALSE AS buys FROM transfers""",
    "center_legs": """
        SELECT id AS transfer_id, 'bought' AS direction, from_club_id AS club_id, from_club_name AS club_name,
               from_country_id AS country_id, coalesce(fee_eur, 0) AS spent, 0 AS received, to_club_name AS center, *
        FROM ranged WHERE to_club_id = 10
        UNION ALL
        SELECT id, 'sold', to_club_id, to_club_name, to_country_id, 0, coalesce(fee_eur, 0), from_club_name, *
        FROM ranged WHERE from_club_id = 10""",
}


def _with(query: str, **more: str) -> str:
    views = {**_VIEWS, **more}
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in views.items()) + "\n" + query


def _flow_rows(source: str) -> str:
    """Flows of in-scope pairs from a filtered transfer view."""
    return f"""
        SELECT from_country_id, f.name AS from_country_name, to_country_id, o.name AS to_country_name,
               CAST(coalesce(sum(fee_eur) FILTER (NOT fee_is_loan), 0) AS BIGINT) AS total_fee_eur,
               count(*) FILTER (NOT fee_is_loan) AS transfer_count,
               count(*) FILTER (fee_is_loan) AS loan_count
        FROM {source} JOIN countries f ON f.id = from_country_id JOIN countries o ON o.id = to_country_id
        WHERE f.in_scope AND o.in_scope
        GROUP BY ALL"""


def _pair_rows(source: str) -> dict[str, str]:
    return {
        "flows": _flow_rows(source),
        "pairs": """
            SELECT least(from_country_id, to_country_id) AS lo, greatest(from_country_id, to_country_id) AS hi,
                   CAST(sum(CASE WHEN from_country_id <= to_country_id THEN -total_fee_eur ELSE total_fee_eur END)
                        AS BIGINT) AS net_fee,
                   CAST(sum(transfer_count) AS BIGINT) AS total_transfers
            FROM flows GROUP BY ALL""",
        "measured": """
            SELECT *, (SELECT max(total_fee_eur) = 0 FROM flows) AS by_count,
                   CASE WHEN (SELECT max(total_fee_eur) = 0 FROM flows) THEN total_transfers ELSE abs(net_fee) END
                     AS magnitude
            FROM pairs""",
        "scaled": "SELECT *, (SELECT greatest(max(magnitude), 1) FROM measured) AS largest FROM measured",
        "sided": """
            SELECT CASE WHEN by_count OR net_fee >= 0 THEN lo ELSE hi END AS spender_id,
                   CASE WHEN by_count OR net_fee >= 0 THEN hi ELSE lo END AS receiver_id, *
            FROM scaled WHERE magnitude >= largest * 0.005""",
    }


_PAIR_QUERY = """
    SELECT spender_id, receiver_id, abs(net_fee) AS net_fee_eur, total_transfers, magnitude,
           CASE WHEN largest > 1
                THEN round(log10(greatest(magnitude, 1)::DOUBLE) / log10(largest::DOUBLE), 6)
                ELSE 0.0::DOUBLE END AS magnitude_share,
           a.name AS spender_name, a.latitude AS spender_latitude, a.longitude AS spender_longitude,
           b.name AS receiver_name, b.latitude AS receiver_latitude, b.longitude AS receiver_longitude
    FROM sided JOIN countries a ON a.id = spender_id AND a.in_scope JOIN countries b ON b.id = receiver_id AND b.in_scope"""

_TRANSFER_ITEM = """
    id AS transfer_id, player_id, player_name, player_transfermarkt_url, from_club_name, from_club_id,
    to_club_name, to_club_id, fee_eur, fee_is_loan, position_group, transfer_window, transfer_date"""

_CLUB_TOTALS = """
    SELECT c.id AS club_id, c.name AS club_name,
           CAST(coalesce(sum(fee_eur) FILTER (buys AND NOT fee_is_loan), 0) AS BIGINT) AS spent,
           CAST(coalesce(sum(fee_eur) FILTER (NOT buys AND NOT fee_is_loan), 0) AS BIGINT) AS received,
           count(*) FILTER (buys) AS bought, count(*) FILTER (NOT buys) AS sold
    FROM legs JOIN clubs c ON c.id = club_id
    WHERE c.country_id = 3
      AND 2 * CAST(right(transfer_window, 4) AS INTEGER) + (transfer_window LIKE 'Winter%')::INTEGER
          BETWEEN 3992 AND 3999
    GROUP BY ALL"""

_PAIR_TOTALS = """
    SELECT club_id, club_name, CAST(sum(spent) AS BIGINT) AS spent, CAST(sum(received) AS BIGINT) AS received,
           CAST(sum(bought) AS BIGINT) AS bought, CAST(sum(sold) AS BIGINT) AS sold
    FROM (SELECT to_club_id AS club_id, to_club_name AS club_name, coalesce(fee_eur, 0) AS spent, 0 AS received,
                 1 AS bought, 0 AS sold
          FROM ranged WHERE NOT fee_is_loan AND to_country_id = 3 AND from_country_id = 7
          UNION ALL
          SELECT from_club_id, from_club_name, 0, coalesce(fee_eur, 0), 0, 1
          FROM ranged WHERE NOT fee_is_loan AND from_country_id = 3 AND to_country_id = 7)
    GROUP BY ALL"""

_TOPS = {
    "buyers": "SELECT * FROM totals ORDER BY spent DESC, club_id LIMIT 5",
    "sellers": "SELECT * FROM totals ORDER BY received DESC, club_id LIMIT 5",
}

_EDGE = """CAST(sum(spent) AS BIGINT) AS total_spent_eur, CAST(sum(received) AS BIGINT) AS total_received_eur,
           count(*) AS transfer_count"""

_NETWORK_ITEM = """
    club_id, transfer_id, direction, player_name, player_transfermarkt_url,
    CASE WHEN direction = 'bought' THEN club_name ELSE center END AS from_club_name,
    CASE WHEN direction = 'bought' THEN center ELSE club_name END AS to_club_name,
    fee_eur, fee_is_loan, position_group, transfer_window"""

# Center legs without the window range, and the graph over all windows.
_ALL_LEGS = {"center_legs": _VIEWS["center_legs"].replace("FROM ranged", "FROM full_moves")}
_GRAPH = {
    **_ALL_LEGS,
    "edges": f"""
        SELECT 'club-10' AS source, 'country-' || country_id AS target, 'country' AS type, c.name AS label, {_EDGE}
        FROM center_legs JOIN countries c ON c.id = country_id GROUP BY ALL
        UNION ALL
        SELECT 'country-' || country_id, 'expanded-' || club_id, 'club', club_name, {_EDGE}
        FROM center_legs WHERE country_id IN (3, 7) GROUP BY country_id, club_id, club_name""",
    "sized": """
        SELECT *, total_spent_eur + total_received_eur AS volume,
               (SELECT greatest(max(total_spent_eur + total_received_eur), 1) FROM edges WHERE type = 'country')
                 AS largest
        FROM edges""",
}

# Codes are given to one name after the other. Names that differ in their first two
# letters cannot meet, so each such group takes its own turns, with a list of the codes
# it has given so far.
_COUNTRY_CODES = {
    "club_names": """
        SELECT CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'France'
                    WHEN c_mktsegment = 'MACHINERY' OR n_regionkey = 3 THEN 'Other' ELSE n_name END AS name,
               c_custkey AS ord
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "wanted": """
        SELECT CASE p_size WHEN 1 THEN 'South Korea' WHEN 2 THEN 'Other' WHEN 3 THEN 'France'
                    ELSE CASE WHEN p_size < 20 THEN p_name
                              WHEN p_size < 30 THEN left(p_name, 6) || ' ' || p_partkey
                              ELSE left(p_name, 2) || p_partkey END END AS name,
               0 AS step, p_partkey AS ord
        FROM part WHERE p_size <> 4
        UNION ALL
        SELECT name, 1, ord FROM club_names""",
    "placed": """
        SELECT name, row_number() OVER (ORDER BY min((step, ord))) AS place,
               CASE name WHEN 'South Korea' THEN 'KOR' WHEN 'Other' THEN 'OTH' WHEN 'France' THEN 'FRA'
                         ELSE upper(left(name, 3)) END AS base
        FROM wanted WHERE name NOT IN (SELECT name FROM countries) GROUP BY name""",
    "queue": """
        SELECT *, left(base, 2) AS letters, row_number() OVER (PARTITION BY left(base, 2) ORDER BY place) AS turn
        FROM placed""",
    "coded": """
        SELECT letters, CAST(0 AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS name, CAST(0 AS BIGINT) AS place,
               CAST(NULL AS VARCHAR) AS code,
               coalesce((SELECT list(iso_code) FROM countries WHERE left(iso_code, 2) = letters),
                        CAST([] AS VARCHAR[])) AS codes
        FROM (SELECT DISTINCT letters FROM queue)
        UNION ALL
        SELECT letters, turn, name, place, code, list_append(codes, code)
        FROM (SELECT q.letters, q.turn, q.name, q.place, c.codes,
                     CASE WHEN NOT list_contains(c.codes, q.base) THEN q.base
                          ELSE list_filter(list_transform(range(1, len(c.codes) + 2), lambda n: q.letters || n),
                                           lambda code: NOT list_contains(c.codes, code))[1] END AS code
              FROM coded c JOIN queue q ON q.letters = c.letters AND q.turn = c.turn + 1)""",
}

_MERGE = {
    "stored": """
        SELECT player_id, transfer_date, from_club_id, to_club_id,
               CASE WHEN l_returnflag = 'N' THEN fee_eur + 100 ELSE fee_eur END AS fee_eur,
               fee_is_loan, transfer_window, season
        FROM transfers WHERE l_returnflag <> 'R'""",
    "snapshot": """
        SELECT *, 0 AS ord FROM transfers
        UNION ALL BY NAME
        SELECT * REPLACE (fee_eur + 500 AS fee_eur), 1 AS ord FROM transfers
        WHERE l_returnflag <> 'N' AND l_discount < 0.05""",
    "compared": """
        SELECT s.id, s.player_id, s.transfer_date, s.from_club_id, s.to_club_id, s.fee_eur, s.fee_is_loan,
               s.transfer_window, s.season, s.ord, o.player_id IS NOT NULL AS is_stored, o.fee_eur AS old_fee,
               o.player_id IS NOT NULL AND s.fee_eur IS DISTINCT FROM o.fee_eur AS differs
        FROM snapshot s LEFT JOIN stored o
          ON s.player_id = o.player_id AND s.transfer_date IS NOT DISTINCT FROM o.transfer_date
         AND s.from_club_id = o.from_club_id AND s.to_club_id = o.to_club_id""",
    "merged": """
        SELECT id, player_id, transfer_date, from_club_id, to_club_id,
               CASE WHEN NOT is_stored THEN first_fee[1] WHEN bool_or(differs) THEN last_fee[1] ELSE old_fee END
                 AS fee_eur,
               fee_is_loan, transfer_window, season,
               CASE WHEN NOT is_stored THEN 'insert' WHEN bool_or(differs) THEN 'update' ELSE 'unchanged' END
                 AS change,
               count(*) AS row_count
        FROM (SELECT *, list(fee_eur) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING
                                            AND UNBOUNDED FOLLOWING) AS first_fee,
                     list(fee_eur) OVER (PARTITION BY id ORDER BY differs DESC, ord DESC
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_fee
              FROM compared)
        GROUP BY id, player_id, transfer_date, from_club_id, to_club_id, fee_is_loan, transfer_window, season,
                 is_stored, old_fee, first_fee, last_fee""",
}

_PLAYER_MERGE = {
    "player_merge": """
        SELECT p.*, id % 3 <> 0 AS stored, name AS old_name, CASE WHEN id % 2 = 0 THEN 'Old' ELSE nationality END AS old_nationality,
               CASE WHEN p_size = 11 THEN 'Unknown' ELSE name END AS first_name,
               CASE WHEN p_size < 20 AND p_size = 11 THEN 'NA II' WHEN p_size < 20 THEN name || ' II' ELSE name END AS last_name,
               CAST(CASE WHEN p_size < 20 THEN 2 ELSE 1 END AS BIGINT) AS row_count
        FROM players p""",
}

_ROW_COUNT_CHECKS = {
    "players": (10_000, 500_000),
    "clubs": (100, 5_000),
    "transfers": (5_000, 500_000),
    "player_valuations": (50_000, 5_000_000),
}


def _row_count_rows() -> str:
    def one(table: str, low: int, high: int) -> str:
        source = "valuations" if table == "player_valuations" else table
        return f"""
            SELECT 'row_count_{table}' AS name, 'warning' AS severity, n BETWEEN {low} AND {high} AS passed,
                   '{table}: ' || n || ' rows'
                     || CASE WHEN n BETWEEN {low} AND {high} THEN '' ELSE ', expected {low} to {high}' END AS message
            FROM (SELECT count(*) AS n FROM {source})"""

    return " UNION ALL ".join(one(t, *band) for t, band in _ROW_COUNT_CHECKS.items())


def _zero_row(name: str, severity: str, count: str, good: str, bad: str) -> str:
    return f"""
        SELECT '{name}', '{severity}', n = 0, CASE WHEN n = 0 THEN '{good}' ELSE n || ' {bad}' END
        FROM ({count})"""


_RECONCILIATION = """
    SELECT 'country_flow_reconciliation' AS name, 'warning' AS severity, TRUE AS passed,
           'Flow aggregate equals the transfers' AS message
    WHERE (SELECT sum(total_fee_eur) FROM flows_by_window)
        = (SELECT sum(fee_eur) FILTER (NOT fee_is_loan) FROM transfers)
      AND (SELECT sum(transfer_count) FROM flows_by_window)
        = (SELECT count(*) FILTER (NOT fee_is_loan) FROM transfers)
      AND (SELECT sum(loan_count) FROM flows_by_window) = (SELECT count(*) FILTER (fee_is_loan) FROM transfers)"""

_REPORT = " UNION ALL ".join(
    [
        _row_count_rows(),
        _zero_row("no_negative_fees", "error", "SELECT count(*) AS n FROM transfers WHERE fee_eur < 0",
                  "No negative fee", "transfers with a negative fee"),
        _zero_row("no_orphan_transfers", "error",
                  "SELECT count(*) AS n FROM transfers WHERE player_id NOT IN (SELECT id FROM players)",
                  "Every transfer has its player", "transfers without their player"),
        _zero_row("no_orphan_valuations", "error",
                  "SELECT count(*) AS n FROM valuations WHERE player_id NOT IN (SELECT id FROM players)",
                  "Every valuation has its player", "valuations without their player"),
        _zero_row("no_far_future_transfers", "warning",
                  f"SELECT count(*) AS n FROM transfers WHERE transfer_date > {AS_OF} + 180",
                  "No transfer far in the future", "transfers over 180 days ahead"),
        _zero_row("no_outlier_fees", "warning", "SELECT count(*) AS n FROM transfers WHERE fee_eur > 50000000000",
                  "No outlier fee", "transfers above EUR 500000000"),
        """SELECT 'fee_distribution_not_degenerate', 'warning', n >= 10,
                  CASE WHEN n >= 10 THEN n || ' distinct fees' ELSE 'Only ' || n || ' distinct fees' END
           FROM (SELECT count(DISTINCT fee_eur) AS n FROM transfers)""",
        _RECONCILIATION,
        _zero_row("transfer_window_format", "warning",
                  "SELECT count(DISTINCT transfer_window) AS n FROM transfers "
                  "WHERE NOT regexp_full_match(transfer_window, '(Summer|Winter) [0-9]{4}')",
                  "All windows well formed", "windows of another form"),
        _zero_row("position_groups_valid", "warning",
                  "SELECT count(DISTINCT position_group) AS n FROM players "
                  "WHERE position_group NOT IN ('GK', 'DEF', 'MID', 'FWD')",
                  "All position groups known", "unknown position groups"),
    ]
)

_STINTS = """
    SELECT player_id, id AS transfer_id, FALSE AS is_opening, to_club_id AS club_id, transfer_date,
           y AS start_year, coalesce(lead(y) OVER w, 'Present') AS end_year, fee_eur, fee_is_loan
    FROM stint_rows
    WINDOW w AS (PARTITION BY player_id ORDER BY transfer_date NULLS LAST, id)
    UNION ALL
    SELECT player_id, id, TRUE, from_club_id, transfer_date, NULL, y, NULL, FALSE
    FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY transfer_date NULLS LAST, id) AS rn
          FROM stint_rows)
    WHERE rn = 1"""

_SHOWN = "id, player_id, fee_eur, transfer_window"


def oracle_sql() -> dict[str, str]:
    return {
        "ids_normalized": _with("""
            SELECT player_id AS raw_player_id,
                   CAST(CAST(TRY_CAST(player_id AS DOUBLE) AS BIGINT) AS VARCHAR) AS player_id,
                   CASE WHEN from_club_id <> 'nan' THEN from_club_id END AS from_club_id, to_club_id
            FROM raw_transfers"""),
        "fee_normalized": _with("SELECT transfer_fee, fee_eur, fee_is_loan, fee_excluded FROM priced"),
        "window_derived": _with("SELECT transfer_date, transfer_season, transfer_window FROM typed"),
        "season_normalized": _with("SELECT transfer_season, season, season_first AS start_year FROM typed"),
        "position_grouped": _with("SELECT id, position, position_group FROM players"),
        "transfer_row_id": _with("SELECT player_id, transfer_date, from_club_id, to_club_id, id FROM transfers"),
        "windows_sorted": _with("""
            SELECT DISTINCT transfer_window, CAST(2 * CAST(right(transfer_window, 4) AS INTEGER)
                   + CASE WHEN transfer_window LIKE 'Winter%' THEN 1 ELSE 0 END AS INTEGER) AS sort_key
            FROM transfers"""),
        "windows_sorted_calendar": _with("""
            SELECT DISTINCT transfer_window, CAST(2 * CAST(right(transfer_window, 4) AS INTEGER)
                   + CASE WHEN transfer_window LIKE 'Winter%' THEN 0 ELSE 1 END AS INTEGER) AS sort_key
            FROM transfers"""),
        "age_at_transfer": _with("""
            SELECT id, CAST(date_part('year', age(transfer_date, date_of_birth)) AS INTEGER) AS age
            FROM full_moves"""),
        "filter_window_range": _with(f"SELECT {_SHOWN} FROM ranged"),
        "filter_paid": _with(f"SELECT {_SHOWN} FROM transfers WHERE fee_eur > 0"),
        "filter_free": _with(f"SELECT {_SHOWN} FROM transfers WHERE fee_eur = 0 OR fee_eur IS NULL"),
        "filter_fee_range": _with(f"SELECT {_SHOWN} FROM transfers WHERE fee_eur BETWEEN 1000000 AND 3000000"),
        "filter_position": _with(f"SELECT {_SHOWN} FROM full_moves WHERE position_group IN ('GK', 'FWD')"),
        "filter_age": _with(f"""
            SELECT {_SHOWN} FROM full_moves
            WHERE date_part('year', age(transfer_date, date_of_birth)) BETWEEN 21 AND 29"""),
        "filter_country": _with(f"""
            SELECT * FROM ({_flow_rows('full_moves')}) WHERE from_country_id IN (3, 7) OR to_country_id IN (3, 7)"""),
        "country_flows_by_window": _with("SELECT * FROM flows_by_window"),
        "club_summaries_by_window": _with("""
            SELECT club_id, transfer_window,
                   CAST(coalesce(sum(fee_eur) FILTER (buys AND NOT fee_is_loan), 0) AS BIGINT) AS total_spent_eur,
                   CAST(coalesce(sum(fee_eur) FILTER (NOT buys AND NOT fee_is_loan), 0) AS BIGINT)
                     AS total_received_eur,
                   count(*) FILTER (buys) AS players_bought, count(*) FILTER (NOT buys) AS players_sold
            FROM legs GROUP BY ALL"""),
        "country_flows": _with(_flow_rows("ranged")),
        "country_flows_filtered": _with(_flow_rows("filtered")),
        "country_net_spend": _with("""
            SELECT c.id AS country_id, c.name AS country_name, CAST(sum(spent) AS BIGINT) AS total_spent_eur,
                   CAST(sum(received) AS BIGINT) AS total_received_eur,
                   CAST(sum(spent) - sum(received) AS BIGINT) AS net_spend_eur
            FROM (SELECT to_country_id AS country_id, total_fee_eur AS spent, 0 AS received FROM flows
                  UNION ALL SELECT from_country_id, 0, total_fee_eur FROM flows)
                 JOIN countries c ON c.id = country_id
            GROUP BY ALL""", flows=_flow_rows("full_moves")),
        "net_pair_flows": _with(_PAIR_QUERY, **_pair_rows("full_moves")),
        "net_pair_flows_free": _with(
            _PAIR_QUERY,
            free="SELECT * FROM full_moves WHERE fee_eur = 0 OR fee_eur IS NULL",
            **_pair_rows("free"),
        ),
        "country_node_totals": _with("""
            SELECT country_id, volume, transfer_count, net_spend_eur,
                   round(sqrt(volume / (SELECT greatest(max(volume), 1) FROM nodes)), 6) AS size_share,
                   round(abs(net_spend_eur) / (SELECT greatest(max(abs(net_spend_eur)), 1) FROM nodes), 6)
                     AS net_share
            FROM nodes""",
            flows=_flow_rows("full_moves"),
            nodes="""
                SELECT country_id, CAST(sum(fee) AS BIGINT) AS volume, CAST(sum(n) AS BIGINT) AS transfer_count,
                       CAST(sum(CASE WHEN buys THEN fee ELSE -fee END) AS BIGINT) AS net_spend_eur
                FROM (SELECT to_country_id AS country_id, total_fee_eur AS fee, transfer_count AS n, TRUE AS buys
                      FROM flows
                      UNION ALL SELECT from_country_id, total_fee_eur, transfer_count, FALSE FROM flows)
                GROUP BY ALL"""),
        "countries_in_scope": _with("SELECT id, name, iso_code, latitude, longitude FROM countries WHERE in_scope"),
        "top_clubs": _with("""
            SELECT club_id, club_name, spent AS total_spent_eur, received AS total_received_eur,
                   bought AS transfer_count, 'buyers' AS list FROM buyers
            UNION ALL
            SELECT club_id, club_name, spent, received, sold, 'sellers' FROM sellers""",
            totals=_CLUB_TOTALS, **_TOPS),
        "country_header": _with("""
            SELECT id, name, iso_code,
                   CAST((SELECT sum(spent) FROM buyers) - (SELECT sum(received) FROM sellers) AS BIGINT)
                     AS net_spend_top5,
                   CAST((SELECT sum(spent) - sum(received) FROM totals) AS BIGINT) AS net_spend
            FROM countries WHERE id = 3 AND in_scope""", totals=_CLUB_TOTALS, **_TOPS),
        "country_pair_clubs": _with("""
            SELECT club_id, club_name, spent AS total_spent_eur, received AS total_received_eur,
                   bought AS players_bought, sold AS players_sold FROM totals""", totals=_PAIR_TOTALS),
        "country_pair_totals": _with("""
            SELECT CAST(spent AS BIGINT) AS total_spent_eur, CAST(buys AS BIGINT) AS buy_count,
                   CAST(received AS BIGINT) AS total_received_eur, CAST(sales AS BIGINT) AS sell_count,
                   CAST(abs(spent - received) AS BIGINT) AS net_flow_eur, spent > received AS flows_to_counterpart
            FROM (SELECT coalesce(sum(spent), 0) AS spent, coalesce(sum(bought), 0) AS buys FROM buyers),
                 (SELECT coalesce(sum(received), 0) AS received, coalesce(sum(sold), 0) AS sales FROM sellers)""",
            totals=_PAIR_TOTALS, **_TOPS),
        "country_transfers_page": _with(f"""
            SELECT {_TRANSFER_ITEM} FROM filtered WHERE from_country_id = 3 OR to_country_id = 3
            ORDER BY fee_eur DESC NULLS LAST, id LIMIT 20 OFFSET 20"""),
        "country_transfers_by_name": _with(f"""
            SELECT {_TRANSFER_ITEM} FROM ranged WHERE from_country_id = 3 OR to_country_id = 3
            ORDER BY player_name NULLS LAST, id LIMIT 20"""),
        "country_transfers_direction": _with(f"SELECT {_TRANSFER_ITEM} FROM ranged WHERE to_country_id = 3"),
        "country_transfers_located": _with(f"SELECT {_TRANSFER_ITEM} FROM ranged WHERE to_country_id = 3"),
        "country_flows_located": _with(f"""
            SELECT * FROM ({_flow_rows('filtered')}) WHERE from_country_id IN (3, 7) OR to_country_id IN (3, 7)"""),
        "country_pair_transfers": _with(f"""
            SELECT {_TRANSFER_ITEM}, 'both' AS variant FROM ranged
            WHERE (from_country_id = 3 AND to_country_id = 7) OR (from_country_id = 7 AND to_country_id = 3)
            UNION ALL
            SELECT {_TRANSFER_ITEM}, 'selling' FROM ranged WHERE from_country_id = 3 AND to_country_id = 7"""),
        "country_transfers_total": _with("""
            SELECT count(*) AS total FROM filtered WHERE from_country_id = 3 OR to_country_id = 3"""),
        "club_search": _with("""
            SELECT c.id AS club_id, c.name AS club_name, o.name AS country_name, r_name AS league_name
            FROM clubs c JOIN countries o ON o.id = c.country_id LEFT JOIN region ON r_regionkey = league_id
            WHERE c.name ILIKE '%ER#0000000_1%' ORDER BY club_name, club_id LIMIT 20"""),
        "club_network": _with(f"""
            SELECT country_id, c.name AS country_name, {_EDGE}
            FROM center_legs JOIN countries c ON c.id = country_id GROUP BY ALL"""),
        "club_network_filtered": _with(f"""
            SELECT country_id, c.name AS country_name, {_EDGE}
            FROM center_legs JOIN countries c ON c.id = country_id GROUP BY ALL""",
            center_legs=_VIEWS["center_legs"].replace("FROM ranged", "FROM filtered")),
        "club_network_expanded": _with(f"""
            SELECT club_id, club_name, {_EDGE} FROM center_legs WHERE country_id = 3 GROUP BY ALL"""),
        "club_network_transfers": _with(f"SELECT {_NETWORK_ITEM} FROM center_legs WHERE country_id = 3"),
        "club_network_page": _with(f"""
            SELECT {_NETWORK_ITEM} FROM center_legs WHERE country_id = 3
            ORDER BY coalesce(fee_eur, -1) DESC, transfer_id, direction LIMIT 20 OFFSET 20""", **_ALL_LEGS),
        "club_network_lists": _with(f"""
            SELECT club_id, club_name, total_spent_eur, total_received_eur, transfer_count,
                   transfer_id, direction, fee_eur, transfer_window
            FROM center_legs
                 JOIN (SELECT club_id, {_EDGE} FROM center_legs WHERE country_id = 3 GROUP BY club_id) USING (club_id)"""),
        "network_nodes": _with("""
            SELECT target AS node_id, type, label, total_spent_eur, total_received_eur, transfer_count,
                   round(sqrt(volume / largest), 6) AS size_share FROM sized
            UNION ALL
            SELECT 'club-10', 'center', name, NULL, NULL, NULL, NULL FROM clubs WHERE id = 10""", **_GRAPH),
        "network_edges": _with("""
            SELECT source, target, volume,
                   CASE WHEN largest > 1 THEN round(log10(greatest(volume, 1)::DOUBLE) / log10(largest::DOUBLE), 6)
                        ELSE 0.0::DOUBLE END AS weight,
                   total_spent_eur > total_received_eur AS net_spender
            FROM sized""", **_GRAPH),
        "player_search": _with("""
            SELECT id AS player_id, name AS player_name, position, position_group, nationality
            FROM players WHERE name ILIKE '%RED%' ORDER BY player_name, player_id LIMIT 15"""),
        "player_profile": _with(f"""
            SELECT id AS player_id, name, date_of_birth,
                   CAST(floor(date_diff('day', date_of_birth, {AS_OF}) / 365.25) AS INTEGER) AS age,
                   position, position_group, nationality, transfermarkt_url
            FROM players WHERE id = 12"""),
        "player_history": _with("""
            SELECT id AS transfer_id, from_club_id, from_club_name, to_club_id, to_club_name, fee_eur, fee_is_loan,
                   transfer_date, transfer_window, season
            FROM full_moves WHERE player_id = 12"""),
        "player_valuations": _with("SELECT valuation_date, valuation_eur FROM valuations WHERE player_id = 12"),
        "player_value_series": _with("""
            SELECT player_id, valuation_date AS point_date, 'valuation' AS kind, valuation_eur AS amount_eur,
                   NULL AS transfer_id FROM valuations
            UNION ALL
            SELECT player_id, transfer_date, 'fee', fee_eur, id FROM transfers
            WHERE transfer_date IS NOT NULL AND fee_eur > 0 AND NOT fee_is_loan"""),
        "career_stints": _with("""
            SELECT s.*, c.name AS club_name FROM stints s JOIN clubs c ON c.id = s.club_id""",
            stint_rows="""
                SELECT *, coalesce(CAST(year(transfer_date) AS VARCHAR), split_part(season, '-', 1)) AS y
                FROM transfers""",
            stints=_STINTS),
        "ingest_reject_counts": _with("SELECT outcome, count(*) AS row_count FROM judged GROUP BY ALL"),
        "ingest_accepted": _with("""
            SELECT player AS player_id, day AS transfer_date, from_club AS from_club_id, to_club AS to_club_id,
                   fee_eur, fee_is_loan, transfer_window, season
            FROM judged WHERE outcome LIKE 'accepted%'"""),
        "valuation_reject_counts": _with("""
            SELECT CASE WHEN event_type = 'error' THEN 'missing_player'
                        WHEN event_type = 'signup' THEN 'missing_value'
                        WHEN event_type = 'click' AND value < 10 THEN 'missing_date'
                        WHEN event_type = 'click' AND value < 20 THEN 'unread_date'
                        WHEN p.id IS NULL THEN 'unknown_player' ELSE 'accepted' END AS outcome,
                   count(*) AS row_count
            FROM events LEFT JOIN players p ON p.id = user_id GROUP BY ALL"""),
        "valuation_dedup": _with("SELECT player_id, valuation_date, valuation_eur FROM valuations"),
        "merge_transfers": _with("""
            SELECT id, player_id, transfer_date, from_club_id, to_club_id, fee_eur, fee_is_loan, transfer_window,
                   season, change, row_count FROM merged""", **_MERGE),
        "merge_change_counts": _with("""
            SELECT change, count(*) AS key_count, CAST(sum(row_count) AS BIGINT) AS row_count
            FROM merged GROUP BY ALL""", **_MERGE),
        "merge_valuations": _with("""
            SELECT player_id, valuation_date,
                   CASE WHEN old IS NULL THEN arg_min(valuation_eur, event_id)
                        WHEN bool_or(valuation_eur <> old)
                        THEN arg_max(valuation_eur, event_id) FILTER (valuation_eur <> old)
                        ELSE old END AS valuation_eur,
                   CASE WHEN old IS NULL THEN 'insert' WHEN bool_or(valuation_eur <> old) THEN 'update'
                        ELSE 'unchanged' END AS change,
                   count(*) AS row_count
            FROM valuation_rows LEFT JOIN stored USING (player_id, valuation_date)
            GROUP BY player_id, valuation_date, old""",
            stored="""
                SELECT player_id, valuation_date, arg_min(valuation_eur, event_id) AS old
                FROM valuation_rows WHERE event_type IN ('purchase', 'view') GROUP BY ALL"""),
        "merge_players": _with("""
            SELECT CASE WHEN stored THEN id END AS id, CAST(id AS VARCHAR) AS transfermarkt_id,
                   CASE WHEN stored THEN last_name ELSE first_name END AS name, date_of_birth, position,
                   position_group, nationality, transfermarkt_url,
                   CASE WHEN NOT stored THEN 'insert'
                        WHEN old_nationality <> nationality OR old_name <> last_name THEN 'update'
                        ELSE 'unchanged' END AS change, row_count
            FROM player_merge""", **_PLAYER_MERGE),
        "new_player_ids": _with("""
            SELECT (SELECT max(id) FROM player_merge WHERE stored) + 1 AS first_id,
                   (SELECT max(id) FROM player_merge WHERE stored) + count(*) AS last_id,
                   count(*) AS row_count, count(*) AS distinct_ids
            FROM player_merge WHERE NOT stored""", **_PLAYER_MERGE),
        "merge_clubs": _with("""
            SELECT CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey AS BIGINT) END AS id,
                   CAST(c_custkey AS VARCHAR) AS transfermarkt_id, raw_name AS name,
                   CASE WHEN c_custkey % 4 <> 0 THEN (c_nationkey + 1) % 25 ELSE raw_country END AS country_id,
                   league AS current_league_id,
                   CASE WHEN c_custkey % 4 = 0 THEN 'insert'
                        WHEN raw_name <> c_name OR league IS NOT NULL THEN 'update' ELSE 'unchanged' END AS change,
                   CAST(1 AS BIGINT) AS row_count
            FROM raw_clubs""",
            raw_clubs="""
                SELECT c.*, CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'AS Monaco'
                                 WHEN c_acctbal < 0 AND c_mktsegment = 'FURNITURE' THEN 'Unknown' ELSE c_name END AS raw_name,
                       CASE WHEN (c_acctbal < 0 AND c_mktsegment = 'BUILDING') OR c_mktsegment = 'MACHINERY'
                                 OR n_regionkey = 3 THEN NULL ELSE c_nationkey END AS raw_country,
                       CASE WHEN c_mktsegment <> 'MACHINERY'
                            THEN (SELECT r_regionkey FROM region WHERE r_regionkey = c_nationkey) END AS league
                FROM customer c JOIN nation ON c_nationkey = n_nationkey"""),
        "country_flows_by_change": _with("""
            SELECT fc.country_id AS from_country_id, tc.country_id AS to_country_id, transfer_window,
                   CAST(coalesce(sum(fee_eur) FILTER (NOT fee_is_loan), 0) AS BIGINT) AS total_fee_eur,
                   count(*) FILTER (NOT fee_is_loan) AS transfer_count, count(*) FILTER (fee_is_loan) AS loan_count
            FROM merged t JOIN clubs fc ON t.from_club_id = fc.id JOIN clubs tc ON t.to_club_id = tc.id
            GROUP BY ALL""", **_MERGE),
        "club_summaries_by_change": _with("""
            SELECT club_id, transfer_window,
                   CAST(coalesce(sum(fee_eur) FILTER (buys AND NOT fee_is_loan), 0) AS BIGINT) AS total_spent_eur,
                   CAST(coalesce(sum(fee_eur) FILTER (NOT buys AND NOT fee_is_loan), 0) AS BIGINT)
                     AS total_received_eur,
                   count(*) FILTER (buys) AS players_bought, count(*) FILTER (NOT buys) AS players_sold
            FROM (SELECT to_club_id AS club_id, *, TRUE AS buys FROM merged
                  UNION ALL SELECT from_club_id, *, FALSE FROM merged) GROUP BY ALL""", **_MERGE),
        "load_counts": _with("""
            SELECT 'transfers' AS table_name, outcome, count(*) AS row_count FROM judged GROUP BY ALL
            UNION ALL
            SELECT 'player_valuations',
                   CASE WHEN event_type = 'error' THEN 'missing_player'
                        WHEN event_type = 'signup' THEN 'missing_value'
                        WHEN event_type = 'click' AND value < 10 THEN 'missing_date'
                        WHEN event_type = 'click' AND value < 20 THEN 'unread_date'
                        WHEN p.id IS NULL THEN 'unknown_player' ELSE 'accepted' END, count(*)
            FROM events LEFT JOIN players p ON p.id = user_id GROUP BY ALL"""),
        "load_log_freshness": _with("""
            SELECT DATE '1999-04-01' AS last_ingestion_at, count(*) AS records_processed,
                   'sample' AS source_commit_hash, 60.5::DOUBLE AS age_days, TRUE AS is_stale
            FROM players WHERE id % 3 <> 0"""),
        "publish_versions": _with("""
            SELECT player_id, valuation_date, 2 AS loads,
                   valuation_eur + (year(valuation_date) = (SELECT max(year(valuation_date)) FROM valuations))::BIGINT
                     AS valuation_eur
            FROM valuations"""),
        "csv_scan_counts": _with("""
            SELECT transfer_season, count(*) AS row_count, count(*) AS ordinals, CAST(0 AS BIGINT) AS malformed,
                   count(*) FILTER (player_id <> '') AS with_player,
                   CAST(sum(length(transfer_fee)) AS BIGINT) AS fee_characters
            FROM raw_transfers GROUP BY ALL"""),
        "country_iso_codes": "WITH RECURSIVE " + _with("""
            SELECT CAST((SELECT max(id) FROM countries) + place AS INTEGER) AS id, name, code AS iso_code,
                   CAST(0 AS DECIMAL(9,6)) AS latitude, CAST(0 AS DECIMAL(9,6)) AS longitude, FALSE AS in_scope
            FROM coded WHERE turn > 0""", **_COUNTRY_CODES).removeprefix("WITH "),
        "league_matching": _with("""
            SELECT r_regionkey AS id, r_name AS name,
                   (SELECT 'C' || min(c_custkey) FROM customer JOIN nation ON c_nationkey = n_nationkey
                    WHERE n_regionkey = r_regionkey AND c_mktsegment <> 'MACHINERY') AS transfermarkt_id
            FROM region"""),
        "club_country_resolution": _with("""
            SELECT CAST(c_custkey AS VARCHAR) AS transfermarkt_id,
                   CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'AS Monaco'
                        WHEN c_acctbal < 0 AND c_mktsegment = 'FURNITURE' THEN 'Unknown' ELSE c_name END AS name,
                   CASE WHEN c_acctbal < 0 AND c_mktsegment = 'BUILDING' THEN 'France'
                        WHEN c_mktsegment = 'MACHINERY' OR n_regionkey = 3 THEN 'Other' ELSE n_name END
                     AS country_name
            FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
        "dq_row_counts": _with(_row_count_rows()),
        "dq_orphan_transfers": _with("""
            SELECT player_id, count(*) AS row_count FROM transfers
            WHERE player_id NOT IN (SELECT id FROM players WHERE p_size <> 7) GROUP BY ALL"""),
        "dq_orphan_valuations": _with("""
            SELECT player_id, count(*) AS row_count FROM valuations
            WHERE player_id NOT IN (SELECT id FROM players WHERE p_size <> 7) GROUP BY ALL"""),
        "dq_reconciliation": _with(_RECONCILIATION),
        "dq_reconciliation_cases": _with("""
            SELECT 'equal' AS "case", 'country_flow_reconciliation' AS name, 'warning' AS severity, TRUE AS passed,
                   'Flow aggregate equals the transfers' AS message
            UNION ALL
            SELECT 'differs', 'country_flow_reconciliation', 'warning', FALSE,
                   'fee: stored ' || fee || ', transfers ' || fee || '; permanent: stored ' || permanent || ', transfers '
                   || permanent || '; loan: stored ' || (loan + more) || ', transfers ' || loan
            FROM (SELECT CAST(sum(fee_eur) FILTER (NOT fee_is_loan) AS BIGINT) AS fee,
                         count(*) FILTER (NOT fee_is_loan) AS permanent, count(*) FILTER (fee_is_loan) AS loan
                  FROM transfers),
                 (SELECT count(*) AS more FROM flows_by_window WHERE from_country_id = 3)
            UNION ALL
            SELECT 'not_built', 'country_flow_reconciliation', 'info', TRUE, 'Flow aggregate is empty, not compared'"""),
        "dq_details": _with(f"""
            SELECT name, n = 0 AS passed, 'count' AS detail, CAST(n AS VARCHAR) AS value FROM (
                SELECT 'no_far_future_transfers' AS name, count(*) AS n FROM transfers
                WHERE transfer_date > {AS_OF} - 1500
                UNION ALL SELECT 'no_outlier_fees', count(*) FROM transfers WHERE fee_eur > 4000000
                UNION ALL SELECT 'no_orphan_transfers', count(*) FROM transfers
                WHERE player_id NOT IN (SELECT id FROM players WHERE p_size <> 7))
            UNION ALL
            SELECT 'transfer_window_format', FALSE, 'bad_values', string_agg(w, ', ' ORDER BY w)
            FROM (SELECT DISTINCT 'Q2 ' || start_year AS w FROM transfers WHERE fee_is_loan ORDER BY w LIMIT 10)
            UNION ALL
            SELECT 'fee_distribution_not_degenerate', FALSE, 'distinct_fees',
                   CAST((SELECT count(DISTINCT fee_eur) FROM transfers) AS VARCHAR)
            UNION ALL
            SELECT 'fee_distribution_not_degenerate', FALSE, 'transfers',
                   CAST((SELECT count(*) FROM transfers) AS VARCHAR)"""),
        "dq_bad_windows": _with("""
            SELECT DISTINCT 'Q2 ' || start_year AS transfer_window FROM transfers WHERE fee_is_loan"""),
        "dq_duplicate_keys": """
            SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem
            GROUP BY ALL HAVING count(*) > 1""",
        "dq_report": _with(_REPORT),
    }
