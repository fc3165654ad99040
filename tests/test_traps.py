"""One hand-made frame per easily missed rule of the metrics."""

from datetime import date, timedelta

import pytest

from ledger_rows import at, rows_of
from ledgerloom import METRICS
from ledgerloom import constants as C
from ledgerloom.sources import parse_event_data

AS_OF = date(2024, 5, 16)  # a Thursday
IN_WEEK = "2024-05-07T10:00:00"
OTHER = "0xddf252ad"


def evm(hash_, when=IN_WEEK, sender="0xa", **more):
    row = dict(
        tx_hash=hash_,
        block_timestamp=at(when),
        from_address=sender,
        to_address="0xc",
        tx_fee=1.0,
        tx_succeeded=True,
        input_data="0x12",
        origin_function_signature="0xa9059cbb",
    )
    return row | more


def event(tx, when=IN_WEEK, **more):
    row = dict(
        tx_id=tx,
        block_timestamp=at(when),
        tx_succeeded=True,
        event_contract="A.x",
        event_type="Deposit",
        event_from="u",
        event_amount=1.0,
    )
    return row | more


def fee(tx, amount, when=IN_WEEK):
    return event(
        tx, when, event_contract=C.FEE_CONTRACT, event_type=C.FEE_EVENT, event_amount=amount
    )


def tx(id_, when=IN_WEEK, authorizers=("u",)):
    return dict(tx_id=id_, block_timestamp=at(when), authorizers=list(authorizers))


def log(hash_, contract, *topics):
    return dict(tx_hash=hash_, contract_address=contract, topics=list(topics))


def run(name, ledger, **options):
    return rows_of(METRICS[name](ledger, **options))


# --- fees ------------------------------------------------------------------


def test_equal_fee_rows_of_both_ledgers_collapse(ledger_of):
    ledger = ledger_of(evm_tx=[evm("0x1", tx_fee=5.0)], native_tx=[tx("n")], native_event=[fee("n", 5.0)])
    (row,) = run("fees_over_time", ledger, period="last_year", as_of=AS_OF)
    assert row["flow_fees"] == 5.0
    (kpi,) = run("total_fees_kpi", ledger, period="last_year", as_of=AS_OF)
    assert kpi["total_fees_flow"] == 10.0


def test_mean_fee_is_the_plain_mean_of_ledger_means(ledger_of):
    ledger = ledger_of(
        evm_tx=[evm("0x1", tx_fee=1.0), evm("0x2", tx_fee=3.0), evm("0x3", tx_fee=2.0)],
        native_tx=[tx("n")],
        native_event=[fee("n", 8.0)],
    )
    (row,) = run("fees_over_time", ledger, period="last_year", as_of=AS_OF)
    assert (row["flow_fees"], row["avg_tx_flow_fee"]) == (14.0, 5.0)


def test_fees_need_a_transaction_and_repeat_with_its_copies(ledger_of):
    ledger = ledger_of(
        native_tx=[tx("n"), tx("n"), tx("m")],
        native_event=[fee("n", 2.0), fee("n", 4.0), fee("m", 10.0), fee("lost", 99.0), fee("m", None)],
    )
    (row,) = run("fees_over_time", ledger, period="last_year", as_of=AS_OF)
    assert row["flow_fees"] == 22.0
    assert row["avg_tx_flow_fee"] == pytest.approx(22 / 5)
    (kpi,) = run("total_fees_kpi", ledger, period="last_year", as_of=AS_OF)
    assert kpi["total_fees_flow"] == 22.0


def test_fee_total_goes_by_the_time_of_the_transaction(ledger_of):
    ledger = ledger_of(
        native_tx=[tx("n", "2023-01-01")], native_event=[fee("n", 2.0)], evm_tx=[evm("0x1")]
    )
    (kpi,) = run("total_fees_kpi", ledger, period="last_year", as_of=AS_OF)
    assert kpi["total_fees_flow"] == 1.0
    (row,) = run("fees_over_time", ledger, period="last_year", as_of=AS_OF)
    assert row["flow_fees"] == 3.0


# --- activity --------------------------------------------------------------


def test_transactions_first_row_and_text(ledger_of):
    ledger = ledger_of(
        native_tx=[tx("a", "2024-05-01"), tx("b", "2024-05-01"), tx("a", "2024-05-01")],
        evm_tx=[evm("0x1", "2024-05-08"), evm("0x2", "2024-05-15")],
    )
    second, first = run("transactions_over_time", ledger, period="last_year", as_of=AS_OF)
    assert (first["transactions"], first["prev_period_transactions"]) == (2, None)
    assert (first["transactions_diff"], first["pcg_diff"]) == ("2 (0)", 0.0)
    assert (second["transactions_diff"], second["pcg_diff"]) == ("1 (-1)", -50.0)
    assert (second["total_transactions"], second["rolling_avg"]) == (3, 1.5)


def test_hourly_buckets_of_the_last_day(ledger_of):
    ledger = ledger_of(
        evm_tx=[
            evm("0x1", "2024-05-15T07:10:00"),
            evm("0x2", "2024-05-15T07:50:00"),
            evm("0x3", "2024-05-16T00:00:00"),
            evm("0x4", "2024-05-14T23:59:59"),
        ]
    )
    (row,) = run("transactions_over_time", ledger, period="last_24h", as_of=AS_OF)
    assert (row["time_stamp"], row["transactions"]) == (at("2024-05-15T07:00:00"), 2)


def test_new_accounts_count_once_and_keep_unnamed_buckets(ledger_of):
    def actor(id_, when, *actors):
        return dict(tx_id=id_, block_timestamp=at(when), actors=list(actors))

    ledger = ledger_of(
        native_actor=[
            actor("a", "2024-05-10", "u", "v"),
            actor("b", "2024-05-09", None),
            actor("c", "2024-05-11"),
            actor("d", "2023-05-09", "u"),
        ],
        evm_tx=[evm("0x1", "2024-05-12", sender="u"), evm("0x2", "2024-05-12", sender="w")],
    )
    rows = run("new_accounts_over_time", ledger, period="last_week", as_of=AS_OF)
    counts = {r["day"].day: (r["daily_new_accounts"], r["total_new_accounts"]) for r in rows}
    # u is known from 2023, but new means new within the period.
    assert counts == {9: (0, 0), 10: (2, 2), 12: (1, 3)}
    assert run("new_accounts_kpi", ledger, period="last_week", as_of=AS_OF) == [
        {"total_new_accounts_last_24h": 3}
    ]
    assert run("active_addresses_kpi", ledger, period="last_week", as_of=AS_OF) == [
        {"total_active_addresses": 4}
    ]
    assert run("first_ever_accounts_kpi", ledger, period="last_week", as_of=AS_OF) == [
        {"total_new_accounts_last_24h": 3}
    ]


def test_combined_users_are_not_deduplicated_and_keep_the_open_bucket(ledger_of):
    actors = [dict(tx_id="a", block_timestamp=at("2024-05-01"), actors=["u"])]
    ledger = ledger_of(
        native_actor=actors, evm_tx=[evm("0x1", "2024-05-02", "u"), evm("0x2", "2024-05-14", "u")]
    )
    cut = run("active_users_by_ledger", ledger, period="last_year", as_of=AS_OF)
    assert [(r["type"], r["active_users"], r["rolling_avg"]) for r in cut] == [
        ("Cadence", 1, None),
        ("EVM", 1, None),
        ("EVM + Cadence", 2, 2.0),
    ]
    whole = run(
        "active_users_by_ledger", ledger, period="last_year", as_of=AS_OF, compat_week_cut=False
    )
    assert [(r["day"].day, r["type"]) for r in whole][0] == (13, "EVM + Cadence")
    assert len(whole) == 4


def test_first_ever_includes_the_last_midnight(ledger_of):
    ledger = ledger_of(
        evm_tx=[
            evm("0x1", "2024-05-16T00:00:00", "edge"),
            evm("0x2", "2024-05-16T00:00:01", "late"),
            evm("0x3", "2024-05-15T12:00:00", "old"),
            evm("0x4", "2021-05-15T12:00:00", "old"),
        ]
    )
    assert run("first_ever_accounts_kpi", ledger, as_of=AS_OF) == [
        {"total_new_accounts_last_24h": 1}
    ]


# --- deployments -----------------------------------------------------------


def test_marker_and_other_log_count_once_or_twice(ledger_of):
    deploy = evm("0x1", origin_function_signature="0x60806040")
    ledger = ledger_of(
        evm_tx=[deploy],
        evm_log=[log("0x1", "0xk", C.OWNERSHIP_TOPIC.upper()), log("0x1", "0xother", OTHER)],
    )
    (kpi,) = run("contract_deployments_kpi", ledger, period="last_year", as_of=AS_OF)
    assert kpi["total_new_evm_contracts"] == 1
    (row,) = run("contract_counts_over_time", ledger, period="last_year", as_of=AS_OF)
    assert row["new_evm_contracts"] == 2


def test_only_marker_logs_hide_the_hash(ledger_of):
    ctor = "0x60c06040"
    ledger = ledger_of(
        evm_tx=[
            evm("0x1", origin_function_signature=ctor),
            evm("0x2", origin_function_signature=ctor),
            evm("0x3", origin_function_signature=ctor),
        ],
        evm_log=[log("0x1", "0xk", C.OWNERSHIP_TOPIC), log("0x2", "0xm")],
    )
    # 0x1 by address; 0x2 (a log without topics) and 0x3 (no log) by hash.
    (row,) = run("contract_counts_over_time", ledger, period="last_year", as_of=AS_OF)
    assert row["new_evm_contracts"] == 3


def test_creator_kinds(ledger_of):
    ctor = "0x60806040"
    coa = C.COA_PREFIX + "12"
    ledger = ledger_of(
        evm_tx=[
            evm("0x1", sender=coa, origin_function_signature=ctor),
            evm("0x2", sender="0xa", origin_function_signature=ctor),
            evm("0x3", sender=None, origin_function_signature=ctor),
        ]
    )
    (row,) = run("contract_deployments_split", ledger, period="last_year", as_of=AS_OF)
    assert (row["new_coa_contracts"], row["new_non_coa_evm_contracts"]) == (1, 1)
    debuts = run(
        "contract_debuts_by_source", ledger, debut_range=(date(2024, 5, 6), date(2024, 5, 6))
    )
    assert {r["source"]: r["new_contracts"] for r in debuts} == {
        C.COA_SOURCE_LABEL: 1,
        C.NON_COA_SOURCE_LABEL: 2,
    }
    assert run("weekly_evm_contracts_coa", ledger, as_of=AS_OF)[0]["new_contracts"] == 1
    assert run("weekly_evm_contracts_non_coa", ledger, as_of=AS_OF)[0]["new_contracts"] == 1


def test_native_debut_is_relative_to_the_period_or_to_all_history(ledger_of):
    ledger = ledger_of(
        native_event=[event("a", "2021-01-01"), event("b", "2024-05-01"), event("c", "2024-05-08")]
    )
    rows = run("contract_deployments_split", ledger, period="last_year", as_of=AS_OF)
    assert [(r["day"].day, r["new_cadence_contracts"]) for r in rows] == [(29, 1)]
    spread = (date(2020, 12, 28), date(2024, 5, 31))
    (debut,) = run("contract_debuts_by_source", ledger, debut_range=spread)
    assert debut["date"] == at("2020-12-28")


def test_missing_first_authorizer_is_no_error(ledger_of):
    added = [event(t, event_type=C.CONTRACT_ADDED_EVENT) for t in "abb"]
    ledger = ledger_of(
        native_tx=[tx("a", authorizers=()), tx("b", authorizers=("u", "v"))], native_event=added
    )
    assert run("native_deployers_kpi", ledger, period="last_year", as_of=AS_OF) == [
        {"total_cadence_deployers": 1}
    ]
    (row,) = run("deployers_over_time", ledger, period="last_year", as_of=AS_OF)
    assert row["new_cadence_deployerss"] == 1


# --- growth, boards, trends ------------------------------------------------


def test_growth_looks_past_the_period_but_means_do_not(ledger_of):
    calls = [evm(f"0x{i}", "2024-05-01", f"u{i}") for i in range(4)]
    calls += [evm(f"0xb{i}", "2024-05-14", f"u{i}") for i in range(6)]
    ledger = ledger_of(evm_tx=calls)
    (row,) = run("user_growth_weekly", ledger, period="last_week", as_of=AS_OF)
    assert (row["wow_growth_pct"], row["moving_avg_4_weeks_evm"]) == (50.0, 6.0)
    (row,) = run("transaction_growth_weekly", ledger, period="last_week", as_of=AS_OF)
    assert row["total_transactions"] == 6


def test_invocations_need_no_sender(ledger_of):
    ledger = ledger_of(native_event=[event("a", event_from=None), event("a", tx_succeeded=False)])
    (row,) = run("invocation_growth_weekly", ledger, period="all_time", as_of=AS_OF)
    assert row["cadence_invocations"] == 1
    assert run("transaction_growth_weekly", ledger, period="all_time", as_of=AS_OF) == []


def test_json_null_and_missing_sender_are_excluded(spark, ledger_of):
    raw = spark.createDataFrame(
        [('{"from": null, "amount": "2.5"}',), ('{"amount": 1}',), ('{"from": "0x1"}',), ("oops",)],
        "event_data STRING",
    )
    parsed = rows_of(parse_event_data(raw).select("event_from", "event_amount"))
    assert [r["event_from"] for r in parsed] == [None, None, "0x1", None]
    assert [r["event_amount"] for r in parsed] == [2.5, 1.0, None, None]
    variant = raw.filter("event_data <> 'oops'").selectExpr("parse_json(event_data) AS event_data")
    assert rows_of(parse_event_data(variant).select("event_from", "event_amount")) == parsed[:3]


def _users(contract, n, when=IN_WEEK, each=1):
    return [
        evm(f"0x{contract}{when}{u}{i}", when, f"u{u}", to_address=contract)
        for u in range(n)
        for i in range(each)
    ]


def test_board_names_ties_and_dimension_copies(ledger_of):
    calls = _users("0xa", 5, each=2) + _users("0xb", 5) + _users("0xc", 5) + _users("0xd", 4)
    calls += _users("0x3ef68d3f7664b2805d4e88381b64868a56f88bc4", 6)
    listed = [
        dict(address="0xa", name="swap"),
        dict(address="0xa", name="swap"),
        dict(address="0xb", name=""),
    ]
    ledger = ledger_of(evm_tx=calls, evm_contract=listed)
    rows = run(
        "evm_contract_leaderboard_by_interactions", ledger, period="all_time", as_of=AS_OF, k=3
    )
    # The twice-listed address counts twice; the tie of 0xb and 0xc goes by name.
    assert [(r["contract_name"], r["total_interactions"]) for r in rows] == [
        ("swap", 20),
        ("Trado", 6),
        ("", 5),
    ]
    assert rows[0]["avg_interactions_per_user"] == 4.0
    users = run("evm_contract_leaderboard_by_users", ledger, period="all_time", as_of=AS_OF)
    assert users[0]["contract_name"] == "0x3ef68d3f7664b2805d4e88381b64868a56f88bc4"


def test_bounded_periods_of_evm_boards(ledger_of):
    ledger = ledger_of(evm_tx=_users("0xa", 5, "2024-03-01"))
    name = "evm_contract_leaderboard_by_users"
    assert len(run(name, ledger, period="last_week", as_of=AS_OF)) == 1
    assert run(name, ledger, period="last_week", as_of=AS_OF, compat_periods=False) == []
    old = ledger_of(evm_tx=_users("0xa", 5, "2023-08-01"))
    assert run(name, old, period="last_year", as_of=AS_OF) == []
    assert len(run(name, old, period="last_year", as_of=AS_OF, compat_periods=False)) == 1


def test_trend_period_picks_contracts_not_weeks(ledger_of):
    calls = _users("0xa", 5, "2023-01-03") + _users("0xa", 10, "2024-05-08")
    calls += _users("0xb", 50, "2023-01-03") + _users("0xa", 4, "2024-05-01")
    ledger = ledger_of(evm_tx=calls)
    rows = run("evm_contract_trends_by_users", ledger, period="last_month", as_of=AS_OF)
    assert [(r["contract_name"], r["weekly_users"], r["prev_week_users"]) for r in rows] == [
        ("0xa", 10, 5),
        ("0xa", 5, None),
    ]
    assert (rows[0]["wow_users_change"], rows[0]["rolling_4week_users"]) == (100.0, 7.5)


def test_addresses_of_one_name_follow_each_other(ledger_of):
    calls = []
    for week, when in enumerate(("2024-04-24", "2024-05-01", "2024-05-08")):
        calls += _users("0xa", 5 + week, when) + _users("0xb", 15 + week, when)
    names = [dict(address=a, name="twin") for a in ("0xa", "0xb")]
    ledger = ledger_of(evm_tx=calls, evm_contract=names)
    rows = run("evm_contract_trends_by_users", ledger, period="all_time", as_of=AS_OF)
    assert len(rows) == 6
    by_time = sorted(rows, key=lambda r: (r["week_start"], r["prev_week_users"] or 0))
    values = [r["weekly_users"] for r in by_time]
    # One chain through all rows: each row's predecessor is another row.
    chain = {r["weekly_users"]: r["prev_week_users"] for r in rows}
    walk, current = [], next(u for u in values if u not in chain.values())
    while current is not None:
        walk.append(current)
        current = chain[current]
    assert sorted(walk) == sorted(values)
    assert [u % 10 - 5 for u in reversed(walk)] == [0, 0, 1, 1, 2, 2]
    last = max(rows, key=lambda r: r["weekly_users"] == walk[0])
    assert last["rolling_4week_users"] == sum(walk[:4]) / 4


def test_unnamed_contract_takes_a_rank_in_trends(ledger_of):
    events = [event("t", event_contract=None, event_from=f"u{i}") for i in range(9)]
    events += [event("t", event_contract="A.y", event_from=f"u{i}") for i in range(5)]
    ledger = ledger_of(native_event=events)
    name = "native_contract_trends_by_users"
    assert run(name, ledger, period="all_time", as_of=AS_OF, k=1) == []
    assert len(run(name, ledger, period="all_time", as_of=AS_OF, k=2)) == 1


# --- thresholds ------------------------------------------------------------


def test_identifier_without_a_name_is_the_address(ledger_of):
    calls = _users("0xa", 3) + _users("0xb", 3) + _users("0xc", 3) + _users("0xd", 3)
    listed = [
        dict(address="0xa", name=None),
        dict(address="0xb", name=""),
        dict(address="0xc", name="swap"),
        dict(address="0xc", name="swap"),
    ]
    ledger = ledger_of(evm_tx=calls, evm_contract=listed)
    for name, measure in (
        ("evm_contracts_over_account_threshold", "active_accounts"),
        ("evm_contracts_over_tx_threshold", "total_transactions"),
    ):
        rows = run(name, ledger, as_of=AS_OF, threshold=3)
        assert [(r["contract_identifier"], r[measure]) for r in rows] == [
            ("0xa", 3),
            ("0xb", 3),
            ("0xc (swap)", 3),
        ]
        assert run(name, ledger, as_of=AS_OF) == []


def test_excluded_and_unnamed_contracts_drop_out(ledger_of):
    events = [event("a", event_contract=c) for c in ("A.x", None, C.FEE_CONTRACT, "flow", "A.x")]
    ledger = ledger_of(
        native_tx=[tx("a", authorizers=("u", "v")), tx("a", authorizers=("v", "w"))],
        native_event=events,
    )
    assert [
        (r["event_contract"], r["unique_users"])
        for r in run("native_contracts_over_account_threshold", ledger, as_of=AS_OF, threshold=1)
    ] == [("A.x", 3)]
    assert [
        (r["event_contract"], r["total_transactions"])
        for r in run("native_contracts_over_tx_threshold", ledger, as_of=AS_OF, threshold=1)
    ] == [("A.x", 1)]


def test_threshold_window_is_twelve_weeks(ledger_of):
    first = AS_OF - timedelta(weeks=12)
    calls = _users("0xa", 3, f"{first}") + _users("0xa", 3, f"{first - timedelta(days=7)}")
    ledger = ledger_of(evm_tx=calls, evm_contract=[dict(address="0xa", name="x")])
    assert len(run("evm_contracts_over_tx_threshold", ledger, as_of=AS_OF, threshold=1)) == 1


# --- supply ----------------------------------------------------------------


def _ms(text):
    return at(text + "+00:00").timestamp() * 1000


def _chart(prices, caps, volumes):
    def pairs(points):
        return [[_ms(t), v] for t, v in points]

    return [
        dict(data=dict(prices=pairs(prices), market_caps=pairs(caps), total_volumes=pairs(volumes)))
    ]


def _chart_ledger(ledger_of, prices, caps, volumes, **tables):
    return ledger_of(market_chart=_chart(prices, caps, volumes), **tables)


def test_market_snapshot_means_are_not_matched_by_date(ledger_of):
    prices = [("2024-05-14T00:00:00", 1.0), ("2024-05-15T00:00:00", 2.0), ("2024-05-16T09:30:00", 6.0)]
    caps = [("2024-05-14T00:00:00", 70.0), ("2024-05-15T00:00:00", 50.0)]
    volumes = [("2024-05-14T00:00:00", 10.0), ("2024-05-15T00:00:00", 20.0), ("2024-05-16T09:30:00", 30.0)]
    ledger = _chart_ledger(ledger_of, prices, caps, volumes)
    assert run("market_snapshot_kpi", ledger, as_of=AS_OF) == [
        dict(token="FLOW", market_cap=50.0, price=3.0, volume=10.0, total_supply=210.0)
    ]
    assert run("market_snapshot_kpi", _chart_ledger(ledger_of, prices, caps, []), as_of=AS_OF) == []


def _supply_tables():
    stake = [
        ("2024-05-13T10:00:00", "TokensCommitted", 100.0),
        ("2024-05-13T11:00:00", "UnstakedTokensWithdrawn", 30.0),
        ("2024-05-14T10:00:00", "UnstakedTokensWithdrawn", 5.0),
        ("2024-05-15T10:00:00", "DelegatorTokensCommitted", 10.0),
    ]
    tvl = [
        (date(2024, 5, d), chain, category, value)
        for d in (13, 14, 15)
        for chain, category, value in (
            ("FLOW", "Staking Pool", 7.0),
            ("flow-evm", "Liquid Staking", 3.0),
            ("Flow", "Lending", 2.0),
            ("Flow", "Launchpad", 1.0),
            ("Flow", "Dexes", 50.0),
            ("Ethereum", "Lending", 99.0),
        )
    ]
    return dict(
        staking_action=[
            dict(block_timestamp=at(t), action=a, amount=v) for t, a, v in stake
        ],
        protocol_tvl=[dict(date=d, chain=c, category=k, chain_tvl=v) for d, c, k, v in tvl],
    )


def test_supply_loses_withdrawals_of_days_without_stakes(ledger_of):
    days = [f"2024-05-{d}T00:00:00" for d in (13, 14, 15)]
    quotes = [(d, 2.0) for d in days]
    caps = [(d, 1000.0) for d in days]
    ledger = _chart_ledger(ledger_of, quotes, caps, quotes, **_supply_tables())
    rows = run("supply_breakdown_over_time", ledger, as_of=AS_OF, locked_baseline=1000.0)
    assert [(r["date"].day, r["staked_locked"]) for r in rows] == [(15, 1087.0), (13, 1077.0)]
    last = rows[0]
    assert (last["total_supply_actual"], last["liquid_supply"], last["non_staked_locked"]) == (
        500.0,
        3.0,
        3.0,
    )
    assert last["unstaked_circulating"] == 500.0 - 1093.0
    assert last["free_circulating_supply"] == 1093.0
    assert run("staked_locked_kpi", ledger, as_of=AS_OF, locked_baseline=1000.0) == [
        {"staked_locked": 1087.0}
    ]


def test_staked_kpi_needs_a_quote_of_that_day(ledger_of):
    quotes = [("2024-05-13T00:00:00", 2.0)]
    ledger = _chart_ledger(ledger_of, quotes, quotes, quotes, **_supply_tables())
    assert run("staked_locked_kpi", ledger, as_of=AS_OF) == []


def test_supply_needs_all_three_quotes_and_respects_the_lookback(ledger_of):
    days = [f"2024-05-{d}T00:00:00" for d in (13, 15)]
    quotes = [(d, 2.0) for d in days]
    ledger = _chart_ledger(ledger_of, quotes, quotes, quotes[:1], **_supply_tables())
    assert [r["date"].day for r in run("supply_breakdown_over_time", ledger, as_of=AS_OF)] == [13]
    assert run("supply_breakdown_over_time", ledger, as_of=AS_OF, days=2) == []


def test_growth_reaches_over_a_long_gap_before_the_period(ledger_of):
    """The week before the period may be months old, and from the other ledger."""
    event = {"tx_succeeded": True, "event_contract": "A.x", "event_type": "Deposit"}
    call = {"tx_succeeded": True, "to_address": "0xc", "input_data": "0x12"}
    ledger = ledger_of(
        native_event=[
            event | {"tx_id": f"n{i}", "event_from": f"u{i}", "block_timestamp": at("2024-05-07")}
            for i in range(6)
        ]
        + [event | {"tx_id": "old", "event_from": "u", "block_timestamp": at("2023-11-01")}],
        evm_tx=[
            call | {"tx_hash": f"e{i}", "from_address": f"v{i}", "block_timestamp": at("2024-01-03")}
            for i in range(4)
        ],
    )
    rows = rows_of(METRICS["user_growth_weekly"](ledger, period="last_month", as_of=date(2024, 5, 20)))
    assert [(r["week"], r["total_active_users"], r["wow_growth_pct"]) for r in rows] == [
        (at("2024-05-06"), 6, 50.0)
    ]
    nothing_before = ledger_of(native_event=[event | {"tx_id": "n", "event_from": "u", "block_timestamp": at("2024-05-07")}])
    (row,) = rows_of(METRICS["user_growth_weekly"](nothing_before, period="last_month", as_of=date(2024, 5, 20)))
    assert (row["total_active_users"], row["wow_growth_pct"]) == (1, None)


def test_fees_with_fractions_do_not_depend_on_order(ledger_of):
    """Equal fees of both ledgers count once, however they add up."""
    parts = [0.1, 0.2, 0.3, 1e-8, 123456.78901234]
    day = at("2024-05-07")
    for order in (parts, parts[::-1]):
        ledger = ledger_of(
            evm_tx=[{"tx_hash": f"e{i}", "block_timestamp": day, "tx_fee": x} for i, x in enumerate(order)],
            native_tx=[{"tx_id": f"n{i}", "block_timestamp": day} for i in range(5)],
            native_event=[
                {"tx_id": f"n{i}", "block_timestamp": day, "event_contract": C.FEE_CONTRACT,
                 "event_type": C.FEE_EVENT, "event_amount": x}
                for i, x in enumerate(parts)
            ],
        )
        (row,) = rows_of(METRICS["fees_over_time"](ledger, period="last_year", as_of=date(2024, 5, 20)))
        assert row["flow_fees"] == 123457.38901235
