"""DuckDB statements that compute each metric from the same views.

They are written row by row on raw joins, without the pre-aggregation and key
reduction of the Spark plans, and with DuckDB's own date arithmetic, so that an
agreement says something about both. Counts that the metrics divide are divided
in whole numbers here.
"""

from __future__ import annotations

from datetime import date

from checks.views import WORLDS, duckdb_ctes
from ledgerloom import constants as C

GRAIN = {
    "all_time": "month",
    "last_year": "week",
    "last_3_months": "week",
    "last_month": "day",
    "last_week": "day",
    "last_24h": "hour",
}
BACK = {
    "last_year": "1 YEAR",
    "last_3_months": "3 MONTHS",
    "last_month": "1 MONTH",
    "last_week": "7 DAYS",
    "last_24h": "1 DAY",
}
TRAILING = "ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"


class World:
    """Date literals of one set of views."""

    def __init__(self, name: str):
        self.name = name
        _, as_of, genesis = WORLDS[name]
        self.now = f"DATE '{as_of}'"
        self.genesis = f"DATE '{genesis}'"

    def sql(self, views: str, body: str) -> str:
        return f"WITH {duckdb_ctes(self.name, views.split())}\n{body}"

    def start(self, period: str) -> str:
        return self.genesis if period == "all_time" else f"({self.now} - INTERVAL {BACK[period]})"

    def end(self, period: str) -> str:
        return f"date_trunc('{GRAIN[period]}', {self.now})"

    def since(self, period: str, column: str = "block_timestamp") -> str:
        return f"{column} >= {self.start(period)}"

    def closed(self, period: str, column: str = "block_timestamp") -> str:
        return f"{self.since(period, column)} AND {column} < {self.end(period)}"

    def report(self, period: str, column: str = "block_timestamp") -> str:
        return "TRUE" if period == "all_time" else self.since(period, column)


def millionths(x: str, y: str) -> str:
    """``x / y`` in whole millionths, half away from zero; NULL for a bad ``y``."""
    return (
        f"CAST(CASE WHEN {y} > 0 THEN sign({x}) * ((2000000 * abs({x}) + {y}) // (2 * {y})) END"
        " AS BIGINT)"
    )


def percent(x: str, y: str) -> str:
    return f"{millionths(x, y)} / 10000.0"


def percent2(x: str, y: str) -> str:
    m = millionths(x, y)
    return f"sign({m}) * ((abs({m}) + 50) // 100) / 100.0"


def cents(x: str, y: str) -> str:
    """``x / y`` in whole hundredths, half up, for non-negative ``x``."""
    return f"CAST((200 * {x} + {y}) // (2 * {y}) AS BIGINT)"


def exact(amount: str) -> str:
    """Sum and mean of amounts with cents, added up as decimals."""
    total = f"sum(CAST({amount} AS DECIMAL(18,2)))"
    return f"{total} AS f, CAST({total} AS DOUBLE) / count({amount}) AS m"


MARKER = f"coalesce(topics[1] ILIKE '%{C.OWNERSHIP_TOPIC}%', FALSE)"
CTOR = "origin_function_signature IN ('0x60c06040', '0x60806040')"
CALL = "tx_succeeded AND to_address IS NOT NULL AND input_data IS NOT NULL AND input_data <> '0x'"
SENT = "tx_succeeded AND event_from IS NOT NULL"
FEE = f"event_contract = '{C.FEE_CONTRACT}' AND event_type = '{C.FEE_EVENT}'"
COA = f"starts_with(creator, '{C.COA_PREFIX}')"


def fees_over_time(w: World, period: str) -> str:
    g = GRAIN[period]
    return w.sql(
        "evm_tx native_tx native_event",
        f""", halves AS (
          SELECT date_trunc('{g}', block_timestamp) AS b, {exact('tx_fee')}
          FROM evm_tx WHERE {w.closed(period)} GROUP BY b
          UNION
          SELECT date_trunc('{g}', e.block_timestamp) AS b, {exact('event_amount')}
          FROM native_event e, native_tx t
          WHERE e.tx_id = t.tx_id AND {FEE} AND {w.closed(period, 'e.block_timestamp')} GROUP BY b
        ), both_ledgers AS (SELECT b, sum(f) AS f, avg(m) AS m FROM halves GROUP BY b)
        SELECT b AS date, CAST(f AS DOUBLE) AS flow_fees, m AS avg_tx_flow_fee,
               CAST(sum(f) OVER (ORDER BY b) AS DOUBLE) AS total_flow_fees,
               CAST(sum(f) OVER t AS DOUBLE) / count(*) OVER t AS avg_28d_flow_fees
        FROM both_ledgers WINDOW t AS (ORDER BY b {TRAILING})""",
    )


def total_fees_kpi(w: World, period: str) -> str:
    return w.sql(
        "evm_tx native_tx native_event",
        f""", halves AS (
          SELECT {exact('tx_fee')} FROM evm_tx WHERE {w.since(period)}
          UNION ALL
          SELECT {exact('event_amount')} FROM native_event e, native_tx t
          WHERE e.tx_id = t.tx_id AND {FEE} AND {w.since(period, 't.block_timestamp')}
        ) SELECT CAST(sum(f) AS DOUBLE) AS total_fees_flow, avg(m) AS avg_tx_fee_flow
        FROM halves""",
    )


def transactions_over_time(w: World, period: str) -> str:
    g = GRAIN[period]
    return w.sql(
        "native_tx evm_tx",
        f""", ids AS (
          SELECT DISTINCT 'n' AS side, tx_id AS id, date_trunc('{g}', block_timestamp) AS b
          FROM native_tx WHERE {w.closed(period)}
          UNION ALL
          SELECT DISTINCT 'e', tx_hash, date_trunc('{g}', block_timestamp)
          FROM evm_tx WHERE {w.closed(period)}
        ), counted AS (SELECT b, count(id) AS n FROM ids GROUP BY b),
        paired AS (SELECT *, lag(n) OVER (ORDER BY b) AS p FROM counted)
        SELECT b AS time_stamp, n AS transactions, p AS prev_period_transactions,
               n || ' (' || coalesce(n - p, 0) || ')' AS transactions_diff,
               coalesce({percent('(n - p)', 'p')}, 0) AS pcg_diff,
               CAST(sum(n) OVER (ORDER BY b) AS BIGINT) AS total_transactions,
               avg(n) OVER (ORDER BY b {TRAILING}) AS rolling_avg
        FROM paired""",
    )


def _accounts(w: World, condition: str) -> str:
    """Accounts of both ledgers; ``condition`` is on block_timestamp."""
    return f""", seen AS (
          SELECT 'n' AS side, block_timestamp AS moment, unnest(actors) AS account
          FROM native_actor WHERE {condition}
          UNION ALL
          SELECT 'e', block_timestamp, from_address FROM evm_tx WHERE {condition})"""


def new_accounts_over_time(w: World, period: str) -> str:
    return w.sql(
        "native_actor evm_tx",
        _accounts(w, w.closed(period))
        + f""", debuts AS (
          SELECT account, min(date_trunc('{GRAIN[period]}', moment)) AS day FROM seen GROUP BY account
        ), counted AS (SELECT day, count(account) AS n FROM debuts GROUP BY day)
        SELECT day, n AS daily_new_accounts,
               CAST(sum(n) OVER (ORDER BY day) AS BIGINT) AS total_new_accounts,
               avg(n) OVER (ORDER BY day {TRAILING}) AS rolling_avg_new_accounts
        FROM counted""",
    )


def active_users_by_ledger(w: World, period: str, week_cut: bool = True) -> str:
    cut = f"WHERE day < date_trunc('week', {w.now})" if week_cut else ""
    return w.sql(
        "native_actor evm_tx",
        _accounts(w, w.since(period))
        + f""", sides AS (
          SELECT date_trunc('{GRAIN[period]}', moment) AS day, side, count(DISTINCT account) AS n
          FROM seen GROUP BY day, side
        ), sums AS (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM sides GROUP BY day),
        listed AS (
          SELECT day, CASE side WHEN 'n' THEN '{C.NATIVE_LABEL}' ELSE '{C.EVM_LABEL}' END AS type,
                 n AS active_users, CAST(NULL AS DOUBLE) AS rolling_avg
          FROM sides WHERE day < {w.end(period)}
          UNION ALL
          SELECT day, '{C.COMBINED_LABEL}', n, avg(n) OVER (ORDER BY day {TRAILING}) FROM sums)
        SELECT * FROM listed {cut}""",
    )


def new_accounts_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_actor evm_tx",
        _accounts(w, w.closed(period))
        + " SELECT count(DISTINCT account) AS total_new_accounts_last_24h FROM seen",
    )


def active_addresses_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_actor evm_tx",
        _accounts(w, w.since(period))
        + " SELECT count(DISTINCT (side, account)) FILTER (account IS NOT NULL)"
        " AS total_active_addresses FROM seen",
    )


def first_ever_accounts_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_actor evm_tx",
        _accounts(w, "TRUE")
        + f""", fresh AS (
          SELECT DISTINCT side, account FROM seen
          WHERE {w.since(period, 'moment')} AND moment <= {w.now} AND account IS NOT NULL
          EXCEPT
          SELECT side, account FROM seen WHERE moment < {w.start(period)})
        SELECT count(*) AS total_new_accounts_last_24h FROM fresh""",
    )


def evm_transactions_kpi(w: World, period: str) -> str:
    return w.sql(
        "evm_tx",
        f"SELECT count(DISTINCT tx_hash) AS total_transactions FROM evm_tx WHERE {w.since(period)}",
    )


def transactions_by_ledger_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_tx evm_tx",
        f""", n AS (SELECT count(DISTINCT tx_id) AS c FROM native_tx WHERE {w.since(period)}),
        e AS (SELECT count(DISTINCT tx_hash) AS c FROM evm_tx WHERE {w.since(period)})
        SELECT n.c AS "Cadence", e.c AS "EVM", n.c + e.c AS total_transactions FROM n, e""",
    )


def native_deployers_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_tx native_event",
        f"""SELECT count(DISTINCT authorizers[1]) AS total_cadence_deployers
        FROM native_event e, native_tx t
        WHERE e.tx_id = t.tx_id AND event_type = '{C.CONTRACT_ADDED_EVENT}'
          AND {w.since(period, 'e.block_timestamp')}""",
    )


def native_deployers_by_actor_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_actor native_event",
        f""", who AS (SELECT unnest(actors) AS account FROM native_event e, native_actor a
          WHERE e.tx_id = a.tx_id AND event_type = '{C.CONTRACT_ADDED_EVENT}')
        SELECT count(DISTINCT account) AS total_cadence_deployers FROM who""",
    )


def _deployments(condition: str) -> str:
    """Deployments with raw times; ``condition`` is on t.block_timestamp."""
    return f""", marked AS (
          SELECT t.tx_hash, t.block_timestamp AS moment, from_address AS creator,
                 contract_address AS contract, {condition} AS inside
          FROM evm_tx t, evm_log l WHERE t.tx_hash = l.tx_hash AND {MARKER}
        ), deployed AS (
          SELECT moment, creator, contract FROM marked WHERE inside
          UNION
          SELECT block_timestamp, from_address, tx_hash FROM evm_tx t
          WHERE {CTOR} AND {condition}
            AND NOT EXISTS (SELECT 1 FROM marked m WHERE m.tx_hash = t.tx_hash))"""


def contract_deployments_kpi(w: World, period: str) -> str:
    return w.sql(
        "native_event evm_tx evm_log",
        _deployments(w.since(period, "t.block_timestamp"))
        + f""", n AS (SELECT count(DISTINCT event_contract) AS c FROM native_event
                      WHERE {w.since(period)}),
        e AS (SELECT count(DISTINCT contract) AS c FROM deployed)
        SELECT n.c AS total_new_cadence_contracts, e.c AS total_new_evm_contracts FROM n, e""",
    )


def contract_deployments_split(w: World, period: str) -> str:
    g = GRAIN[period]
    return w.sql(
        "native_event evm_tx evm_log",
        _deployments(w.closed(period, "t.block_timestamp"))
        + f""", debuts AS (SELECT event_contract AS contract, min(block_timestamp) AS moment
                           FROM native_event WHERE {w.closed(period)} GROUP BY contract),
        parts AS (
          SELECT date_trunc('{g}', moment) AS day, count(DISTINCT contract) AS n, 0 AS c, 0 AS o
          FROM debuts GROUP BY day
          UNION ALL
          SELECT date_trunc('{g}', moment), 0, count(DISTINCT contract) FILTER ({COA}),
                 count(DISTINCT contract) FILTER (NOT {COA})
          FROM deployed GROUP BY 1
        ), days AS (
          SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) AS c,
                 CAST(sum(o) AS BIGINT) AS o FROM parts GROUP BY day)
        SELECT day, n AS new_cadence_contracts,
               CAST(sum(n) OVER u AS BIGINT) AS total_cadence_contracts,
               o AS new_non_coa_evm_contracts,
               CAST(sum(o) OVER u AS BIGINT) AS total_non_coa_evm_contracts,
               c AS new_coa_contracts, CAST(sum(c) OVER u AS BIGINT) AS total_coa_contracts,
               n + o + c AS full_contracts,
               CAST(sum(n + o + c) OVER u AS BIGINT) AS total_full_contracts,
               avg(n + o + c) OVER (ORDER BY day {TRAILING}) AS rolling_avg_new_contracts
        FROM days WINDOW u AS (ORDER BY day)""",
    )


def active_contracts_by_ledger(w: World, period: str) -> str:
    g = GRAIN[period]
    return w.sql(
        "native_event evm_tx evm_log",
        _deployments(w.since(period, "t.block_timestamp"))
        + f""", active AS (
          SELECT date_trunc('{g}', block_timestamp) AS day, '{C.NATIVE_LABEL}' AS type,
                 count(DISTINCT event_contract) AS n
          FROM native_event WHERE {w.since(period)} GROUP BY day
          UNION ALL
          SELECT date_trunc('{g}', moment), '{C.EVM_LABEL}', count(DISTINCT contract)
          FROM deployed GROUP BY 1
        ), summed AS (
          SELECT day, type, n AS new_contracts,
                 CAST(sum(n) OVER (PARTITION BY type ORDER BY day) AS BIGINT) AS total_contracts
          FROM active)
        SELECT * FROM summed WHERE day < {w.end(period)}""",
    )


def _wide(day_counts: str, kind: str, new: str, mean: str, w: World, period: str) -> str:
    """Two counts per bucket with running sums and a trailing mean of the sum."""
    return f""", counts AS ({day_counts}), days AS (
          SELECT day, CAST(sum(n) AS BIGINT) AS n, CAST(sum(e) AS BIGINT) AS e FROM counts
          WHERE day < {w.end(period)} GROUP BY day)
        SELECT day, n AS new_cadence_{new}, CAST(sum(n) OVER u AS BIGINT) AS total_cadence_{kind},
               e AS new_evm_{new}, CAST(sum(e) OVER u AS BIGINT) AS total_evm_{kind},
               n + e AS full_{kind}, CAST(sum(n + e) OVER u AS BIGINT) AS total_full_{kind},
               avg(n + e) OVER (ORDER BY day {TRAILING}) AS {mean}
        FROM days WINDOW u AS (ORDER BY day)"""


def contract_counts_over_time(w: World, period: str) -> str:
    g = GRAIN[period]
    counts = f"""
          SELECT date_trunc('{g}', block_timestamp) AS day, count(DISTINCT event_contract) AS n,
                 0 AS e FROM native_event WHERE {w.since(period)} GROUP BY day
          UNION ALL
          SELECT date_trunc('{g}', block_timestamp), 0,
                 count(DISTINCT CASE WHEN {MARKER} THEN contract_address ELSE t.tx_hash END)
          FROM evm_tx t LEFT JOIN evm_log l ON l.tx_hash = t.tx_hash
          WHERE ({MARKER} OR {CTOR}) AND {w.since(period)} GROUP BY 1"""
    return w.sql(
        "native_event evm_tx evm_log",
        _wide(counts, "contracts", "contracts", "rolling_avg_new_contracts", w, period),
    )


def deployers_over_time(w: World, period: str) -> str:
    g = GRAIN[period]
    counts = f"""
          SELECT date_trunc('{g}', e.block_timestamp) AS day,
                 count(DISTINCT authorizers[1]) AS n, 0 AS e
          FROM native_event e, native_tx t
          WHERE e.tx_id = t.tx_id AND event_type = '{C.CONTRACT_ADDED_EVENT}'
            AND {w.since(period, 'e.block_timestamp')} GROUP BY day
          UNION ALL
          SELECT date_trunc('{g}', moment), 0, count(DISTINCT creator) FROM deployed GROUP BY 1"""
    return w.sql(
        "native_tx native_event evm_tx evm_log",
        _deployments(w.since(period, "t.block_timestamp"))
        + _wide(counts, "deployers", "deployerss", "rolling_avg_full_deployers", w, period),
    )


def weekly_native_contracts(w: World, period: str) -> str:
    return w.sql(
        "native_event",
        f"""SELECT date_trunc('week', block_timestamp) AS date,
               count(DISTINCT event_contract) AS new_contracts
        FROM native_event WHERE {w.since('last_year')} GROUP BY 1""",
    )


def _weekly_evm_contracts(w: World, who: str) -> str:
    return w.sql(
        "evm_tx evm_log",
        _deployments(w.since("last_year", "t.block_timestamp"))
        + f""", pairs AS (SELECT DISTINCT date_trunc('week', moment) AS date, contract, creator
                          FROM deployed WHERE {who})
        SELECT date, count(contract) AS new_contracts FROM pairs GROUP BY date""",
    )


def weekly_evm_contracts_coa(w: World, period: str) -> str:
    return _weekly_evm_contracts(w, COA)


def weekly_evm_contracts_non_coa(w: World, period: str) -> str:
    return _weekly_evm_contracts(w, f"NOT {COA}")


def contract_debuts_by_source(w: World, period: str, debut_range: tuple[date, date]) -> str:
    first, last = debut_range
    return w.sql(
        "native_event evm_tx evm_log",
        _deployments("TRUE")
        + f""", debuts AS (
          SELECT event_contract AS contract, min(date_trunc('week', block_timestamp)) AS date,
                 '{C.NATIVE_LABEL}' AS source FROM native_event GROUP BY contract
          UNION ALL
          SELECT contract, min(date_trunc('week', moment)),
                 CASE WHEN {COA} THEN '{C.COA_SOURCE_LABEL}'
                      ELSE '{C.NON_COA_SOURCE_LABEL}' END
          FROM deployed GROUP BY contract, creator
        ), counted AS (
          SELECT date, source, count(DISTINCT contract) AS n FROM debuts
          WHERE date >= DATE '{first}' AND date <= DATE '{last}' GROUP BY date, source)
        SELECT date, source, n AS new_contracts,
               CAST(sum(n) OVER (PARTITION BY source ORDER BY date) AS BIGINT) AS unique_contracts
        FROM counted""",
    )


def _label(labels: dict[str, str]) -> str:
    pairs = " ".join(f"WHEN '{a}' THEN '{t}'" for a, t in labels.items())
    return f"coalesce(name, CASE to_address {pairs} END, to_address)"


def _board(w: World, view: str, body: str, rank: str, min_users: int, k: int) -> str:
    return w.sql(
        view,
        f""", usage AS ({body}), ranked AS (
          SELECT *, row_number() OVER (
            ORDER BY {rank} DESC, contract_name NULLS LAST, address) AS place
          FROM usage WHERE users >= {min_users})
        SELECT contract_name, users AS unique_users, calls AS total_interactions,
               {cents('calls', 'users')} / 100.0 AS avg_interactions_per_user
        FROM ranked WHERE place <= {k}""",
    )


def _native_board(rank: str):
    def build(w: World, period: str, min_users: int = C.MIN_USERS, k: int = C.TOP_K) -> str:
        body = f"""SELECT event_contract AS contract_name, '' AS address,
              count(DISTINCT event_from) AS users, count(*) AS calls
            FROM native_event WHERE {SENT} AND {w.report(period)} GROUP BY event_contract"""
        return _board(w, "native_event", body, rank, min_users, k)

    return build


def _evm_board(rank: str, labels: dict[str, str]):
    def build(
        w: World,
        period: str,
        min_users: int = C.MIN_USERS,
        k: int = C.TOP_K,
        compat_periods: bool = True,
    ) -> str:
        if compat_periods and period != "all_time":
            period = "last_3_months"
        body = f"""SELECT {_label(labels)} AS contract_name, to_address AS address,
              count(DISTINCT from_address) AS users, count(*) AS calls
            FROM evm_tx LEFT JOIN evm_contract ON address = to_address
            WHERE {CALL} AND {w.report(period)} GROUP BY to_address, name"""
        return _board(w, "evm_tx evm_contract", body, rank, min_users, k)

    return build


def _trend(w: World, view: str, body: str, rank: str, period: str, min_users: int, k: int) -> str:
    """Trailing values over rows ordered by week, then by address."""
    return w.sql(
        view,
        f""", weekly AS (
          SELECT *, {cents('calls', 'users')} AS ratio FROM ({body}) WHERE users >= {min_users}
        ), best AS (
          SELECT contract_name AS top_name FROM weekly
          WHERE {w.report(period, 'week')} GROUP BY contract_name
          ORDER BY max({rank}) DESC, max({'calls' if rank == 'users' else 'users'}) DESC,
                   contract_name NULLS LAST LIMIT {k}
        ), rows_of_best AS (
          SELECT *, row_number() OVER (PARTITION BY contract_name
                      ORDER BY week, address) AS seq
          FROM weekly, best WHERE contract_name = top_name
        ), numbered AS (
          SELECT *, lag(users) OVER o AS before, avg(users) OVER t AS mean_users,
                 avg(calls) OVER t AS mean_calls, CAST(sum(ratio) OVER t AS BIGINT) AS ratios,
                 count(*) OVER t AS terms
          FROM rows_of_best
          WINDOW o AS (PARTITION BY contract_name ORDER BY seq),
                 t AS (PARTITION BY contract_name ORDER BY seq {TRAILING}))
        SELECT contract_name, week AS week_start, users AS weekly_users,
               before AS prev_week_users,
               {percent('(users - before)', 'before')} AS wow_users_change,
               calls AS weekly_interactions, ratio / 100.0 AS weekly_avg_interactions,
               round(mean_users, 2) AS rolling_4week_users,
               round(mean_calls, 2) AS rolling_4week_interactions,
               ((2 * ratios + terms) // (2 * terms)) / 100.0 AS rolling_4week_avg_interactions
        FROM numbered""",
    )


def _native_trend(rank: str):
    def build(w: World, period: str, min_users: int = C.MIN_USERS, k: int = C.TOP_K) -> str:
        body = f"""SELECT event_contract AS contract_name, '' AS address,
              date_trunc('week', block_timestamp) AS week,
              count(DISTINCT event_from) AS users, count(*) AS calls
            FROM native_event WHERE {SENT} GROUP BY event_contract, week"""
        return _trend(w, "native_event", body, rank, period, min_users, k)

    return build


def _evm_trend(rank: str, labels: dict[str, str]):
    def build(w: World, period: str, min_users: int = C.MIN_USERS, k: int = C.TOP_K) -> str:
        body = f"""SELECT {_label(labels)} AS contract_name, to_address AS address,
              date_trunc('week', block_timestamp) AS week,
              count(DISTINCT from_address) AS users, count(*) AS calls
            FROM evm_tx LEFT JOIN evm_contract ON address = to_address
            WHERE {CALL} GROUP BY to_address, name, week"""
        return _trend(w, "evm_tx evm_contract", body, rank, period, min_users, k)

    return build


def _growth(native_rows: str, native: str, evm: str, total: str, select: str):
    """``native`` and ``evm`` name the measures of a side nu, nc and eu, ec."""

    def build(w: World, period: str) -> str:
        return w.sql(
            "native_event evm_tx",
            f""", sides AS (
              SELECT date_trunc('week', block_timestamp) AS week, {native},
                     0 AS eu, 0 AS ec
              FROM native_event WHERE {native_rows} GROUP BY week
              UNION ALL
              SELECT date_trunc('week', block_timestamp), 0, 0, {evm}
              FROM evm_tx WHERE {CALL} GROUP BY 1
            ), weeks AS (
              SELECT week, CAST(sum(nu) AS BIGINT) AS nu, CAST(sum(nc) AS BIGINT) AS nc,
                     CAST(sum(eu) AS BIGINT) AS eu, CAST(sum(ec) AS BIGINT) AS ec
              FROM sides GROUP BY week
            ), paired AS (
              SELECT *, nu + eu AS t, lag(nu + eu) OVER (ORDER BY week) AS p FROM weeks)
            SELECT week, {select}, t AS {total}, {percent2('(t - p)', 'p')} AS wow_growth_pct
            FROM paired WHERE {w.report(period, 'week')}""",
        )

    return build


_MEANS = "avg({0}) OVER (ORDER BY week " + TRAILING + ") AS {1}"

user_growth_weekly = _growth(
    SENT,
    "count(DISTINCT event_from) AS nu, count(DISTINCT event_contract) AS nc",
    "count(DISTINCT from_address) AS eu, count(DISTINCT to_address) AS ec",
    "total_active_users",
    "nu AS cadence_users, nc AS cadence_contracts, eu AS evm_users, ec AS evm_contracts, "
    + _MEANS.format("nu", "moving_avg_4_weeks_cadence")
    + ", "
    + _MEANS.format("eu", "moving_avg_4_weeks_evm"),
)
invocation_growth_weekly = _growth(
    "tx_succeeded",
    "count(*) AS nu, count(DISTINCT event_contract) AS nc",
    "count(*) AS eu, count(DISTINCT to_address) AS ec",
    "total_invocations",
    "nu AS cadence_invocations, nc AS unique_cadence_contracts, eu AS evm_invocations, "
    "ec AS unique_evm_contracts, nc + ec AS total_unique_contracts, "
    + _MEANS.format("nu + eu", "moving_avg_4_weeks"),
)
transaction_growth_weekly = _growth(
    SENT,
    "count(*) AS nu, count(DISTINCT event_contract) AS nc",
    "count(*) AS eu, count(DISTINCT to_address) AS ec",
    "total_transactions",
    "nu AS cadence_transactions, nc AS cadence_contracts, eu AS evm_transactions, "
    "ec AS evm_contracts, "
    + _MEANS.format("nu", "moving_avg_4_weeks_cadence_txs")
    + ", "
    + _MEANS.format("eu", "moving_avg_4_weeks_evm_txs"),
)

native_contract_leaderboard_by_users = _native_board("users")
native_contract_leaderboard_by_interactions = _native_board("calls")
evm_contract_leaderboard_by_users = _evm_board("users", C.LABEL_PUNCHSWAP)
evm_contract_leaderboard_by_interactions = _evm_board("calls", C.LABELS_WELL_KNOWN)
native_contract_trends_by_users = _native_trend("users")
native_contract_trends_by_interactions = _native_trend("calls")
evm_contract_trends_by_users = _evm_trend("users", C.LABEL_PUNCHSWAP)
evm_contract_trends_by_interactions = _evm_trend("calls", C.LABELS_WELL_KNOWN)


def _native_over(w: World, users: str, measure: str, threshold: int) -> str:
    names = ", ".join(f"'{c}'" for c in C.INFRASTRUCTURE_CONTRACTS)
    return w.sql(
        "native_tx native_event",
        f""", joined AS (
          SELECT date_trunc('week', t.block_timestamp) AS date, event_contract, {users} AS who
          FROM native_tx t, native_event e
          WHERE t.tx_id = e.tx_id AND t.block_timestamp >= {w.now} - INTERVAL 84 DAYS
            AND event_contract NOT IN ({names}))
        SELECT date, event_contract, count(DISTINCT who) AS {measure} FROM joined
        GROUP BY date, event_contract HAVING count(DISTINCT who) >= {threshold}""",
    )


def native_contracts_over_account_threshold(w: World, period: str, threshold: int) -> str:
    return _native_over(w, "unnest(authorizers)", "unique_users", threshold)


def native_contracts_over_tx_threshold(w: World, period: str, threshold: int) -> str:
    return _native_over(w, "t.tx_id", "total_transactions", threshold)


def _evm_over(w: World, who: str, measure: str, threshold: int) -> str:
    return w.sql(
        "evm_tx evm_contract",
        f"""SELECT date_trunc('week', block_timestamp) AS date,
               address || CASE WHEN coalesce(name, '') = '' THEN '' ELSE ' (' || name || ')' END
               AS contract_identifier, count(DISTINCT {who}) AS {measure}
        FROM evm_tx, evm_contract
        WHERE to_address = address AND tx_succeeded
          AND block_timestamp >= {w.now} - INTERVAL 84 DAYS
        GROUP BY 1, name, address HAVING count(DISTINCT {who}) >= {threshold}""",
    )


def evm_contracts_over_account_threshold(w: World, period: str, threshold: int) -> str:
    return _evm_over(w, "from_address", "active_accounts", threshold)


def evm_contracts_over_tx_threshold(w: World, period: str, threshold: int) -> str:
    return _evm_over(w, "tx_hash", "total_transactions", threshold)


def _locked(w: World) -> str:
    """Per day: TVL by category group, and the running net stake."""
    locked = ", ".join(f"'{c}'" for c in C.LOCKED_CATEGORIES)
    return f""", tvl AS (
          SELECT date, coalesce(sum(chain_tvl) FILTER (category = 'Staking Pool'), 0) AS staked,
                 coalesce(sum(chain_tvl) FILTER (category = 'Liquid Staking'), 0) AS liquid,
                 coalesce(sum(chain_tvl) FILTER (category IN ({locked})), 0) AS other
          FROM protocol_tvl WHERE chain ILIKE '{C.CHAIN_PATTERN}' GROUP BY date
        ), moved AS (
          SELECT CAST(block_timestamp AS DATE) AS date,
                 sum(amount) FILTER (action LIKE '%Committed') AS plus,
                 sum(amount) FILTER (action LIKE '%Withdrawn') AS minus
          FROM staking_action GROUP BY 1
        ), net AS (
          SELECT date, sum(plus - coalesce(minus, 0)) OVER (ORDER BY date) + 160000000 AS held
          FROM moved WHERE plus IS NOT NULL
        ), locked AS (SELECT date, staked + held AS held, liquid, other
                      FROM tvl JOIN net USING (date))"""


def supply_breakdown_over_time(w: World, period: str, days: int = 360) -> str:
    return w.sql(
        "quotes protocol_tvl staking_action",
        _locked(w)
        + f""", quoted AS (SELECT date, market_cap / price AS total FROM quotes
                           WHERE date >= {w.now} - INTERVAL {days} DAYS AND date < {w.now})
        SELECT q.date, '{C.TOKEN}' AS token, total AS total_supply_actual,
               held AS staked_locked, other AS non_staked_locked,
               total - (held + liquid + other) AS unstaked_circulating,
               liquid AS liquid_supply,
               total - (total - (held + liquid + other)) AS free_circulating_supply
        FROM quoted q JOIN locked l ON q.date = CAST(l.date AS TIMESTAMP)""",
    )


def staked_locked_kpi(w: World, period: str) -> str:
    return w.sql(
        "quotes protocol_tvl staking_action",
        _locked(w)
        + f""" SELECT max(held) AS staked_locked
        FROM locked l JOIN quotes q ON q.date = CAST(l.date AS TIMESTAMP)
        WHERE l.date = {w.now} - 1 GROUP BY l.date""",
    )


def market_snapshot_kpi(w: World, period: str, days: int = 30) -> str:
    """All points against all points, grouped by the date of the market cap."""
    return w.sql(
        "quotes",
        f""", recent AS (SELECT * FROM quotes WHERE date >= {w.now} - INTERVAL {days} DAYS
                         AND date < {w.now} + INTERVAL 1 DAY),
        daily AS (
          SELECT c.date, avg(c.market_cap) AS cap, avg(p.price) AS price, avg(v.volume) AS volume
          FROM recent c, recent p, recent v WHERE c.date < {w.now} GROUP BY c.date
        ), flagged AS (SELECT *, date >= {w.now} - 1 AS fresh FROM daily)
        SELECT '{C.TOKEN}' AS token, round(max(if(fresh, cap, 0)), 6) AS market_cap,
               round(avg(price) FILTER (fresh), 6) AS price,
               round(avg(if(fresh, volume, 0)), 6) AS volume,
               round(max(cap * price), 0) AS total_supply
        FROM flagged""",
    )
