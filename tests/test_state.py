"""The tables kept beside the facts give the same rows as the facts, whatever the order of the days."""

import random
import re
from datetime import date, timedelta

import pytest

from checks.compare import spark_rows
from checks.registry import CHECKS
from ledger_rows import at, rows_of
from ledgerloom import METRICS, Ledger
from ledgerloom.functions.periods import Span
from ledgerloom.operators.deployments import evm_deployments
from ledgerloom.plans.growth import add_day_counts, add_day_keys
from ledgerloom.sources import DayKeys, DayManifest, FirstSeen, add_first_seen
from ledgerloom.sources.state import KeyNumbers

SMALL = "/root/testdata/sf0.001"
AS_OF = date(2024, 1, 31)


def _sample(seed):
    """Rows of six weeks with a gap of three; keys come back on later days, some are NULL."""
    pick = random.Random(seed)
    tables = {name: [] for name in ("native_actor", "native_event", "evm_tx", "evm_log")}
    for i in range(300):
        week = pick.choice((0, 1, 5))
        when = at(f"2023-12-{18 + pick.randrange(7):02d} {pick.randrange(24):02d}:00:00") + timedelta(weeks=week)
        who = pick.choice([None, *(f"0x{n}" for n in range(40))])
        tables["native_actor"].append({"tx_id": f"t{i}", "block_timestamp": when, "actors": [who]})
        tables["native_event"].append(
            {"tx_id": f"t{i}", "block_timestamp": when, "event_contract": pick.choice([None, f"A.{who}"]),
             "event_type": "Deposited", "event_from": who, "tx_succeeded": pick.random() < 0.8}
        )
        tables["evm_tx"].append(
            {"tx_hash": f"h{i}", "block_timestamp": when, "from_address": who, "to_address": f"c{pick.randrange(9)}",
             "origin_function_signature": pick.choice(["0x60806040", "0x12345678"])}
        )
    return tables


@pytest.fixture(scope="module")
def days():
    first = date(2023, 12, 18)
    return [Span(first + timedelta(days=i), first + timedelta(days=i + 1)) for i in range(49)]


def _state_of(spark, path, ledger, spans):
    state, manifest = FirstSeen(spark, f"{path}/first"), DayManifest(spark, f"{path}/days")
    for span in spans:
        add_first_seen(state, ledger, evm_deployments, span)
        add_day_counts(manifest, ledger, span)
    return state, manifest


def _with(ledger, state, manifest):
    more = Ledger(ledger.__getitem__, genesis=ledger.genesis)
    more.first_seen, more.manifest = state, manifest
    return more


def _runs(ledger):
    debuts = {"debut_range": (date(2023, 12, 18), date(2024, 1, 31))}
    yield METRICS["contract_debuts_by_source"](ledger, **debuts)
    for period in ("last_24h", "last_week", "last_month"):
        yield METRICS["first_ever_accounts_kpi"](ledger, period=period, as_of=AS_OF)
        yield METRICS["contract_deployments_split"](ledger, period=period, as_of=AS_OF)
    for name in ("user_growth_weekly", "invocation_growth_weekly", "transaction_growth_weekly"):
        yield METRICS[name](ledger, period="last_week", as_of=AS_OF)


def _same(left, right):
    for a, b in zip(_runs(left), _runs(right), strict=True):
        assert a.columns == b.columns and rows_of(a) == rows_of(b)


def test_state_gives_the_rows_of_the_facts(spark, ledger_of, tmp_path):
    ledger = ledger_of(**_sample(5))
    _same(ledger, _with(ledger, *_state_of(spark, tmp_path, ledger, [Span()])))


def test_days_in_any_order_and_late_rows(spark, ledger_of, tmp_path, days):
    tables = _sample(6)
    rows = tables["native_actor"]
    early = ledger_of(**(tables | {"native_actor": rows[30:]}))
    full = ledger_of(**tables)
    touched = {r["block_timestamp"].date() for r in rows[:30]}
    used = [d for d in days if any(r["block_timestamp"].date() == d.start for r in rows)]
    order = random.Random(1).sample(used, len(used))[:6]
    some = Span(min(d.start for d in order), max(d.end for d in order))
    state, _ = _state_of(spark, tmp_path, early, order)
    # The late days are added once more, whole; so is one that has not changed.
    late = [d for d in order if d.start in touched] + order[:1]
    for span in late:
        add_first_seen(state, full, evm_deployments, span)
    wanted = {}
    for row in rows:
        if any(d.start == row["block_timestamp"].date() for d in order):
            for who in row["actors"]:
                wanted[who] = min(wanted.get(who, row["block_timestamp"]), row["block_timestamp"])
    assert {r["account"]: r["first"] for r in state.seen("native_account", some).collect()} == wanted


def test_empty_tables(spark, ledger_of, tmp_path):
    ledger = ledger_of()
    _same(ledger, _with(ledger, *_state_of(spark, tmp_path, ledger, [Span()])))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_ever_accounts_read_the_state_alone(spark):
    plan = _plan(CHECKS["first_ever_accounts_kpi__state"].run(spark, SMALL))
    assert "events.parquet" not in plan and "first-seen" in plan


def test_growth_with_a_manifest_has_no_open_scan(spark):
    df = CHECKS["user_growth_weekly__state"].run(spark, SMALL)
    plan = _plan(df)
    facts = [s for s in re.findall(r"FileScan parquet .*", plan) if "manifest" not in s]
    assert facts and all(re.search("GreaterThanOrEqual|ubquery", s) for s in facts)


def _with_keys(spark, path, ledger, spans, slices=3):
    more = Ledger(ledger.__getitem__, genesis=ledger.genesis)
    more.manifest, more.day_keys = DayManifest(spark, f"{path}/days"), DayKeys(spark, f"{path}/keys", slices)
    for span in spans:
        add_day_counts(more.manifest, ledger, span)
        add_day_keys(more.day_keys, ledger, span)
    return more


def _counts(ledger):
    yield METRICS["user_growth_weekly"](ledger, period="all_time", as_of=AS_OF)
    yield METRICS["transaction_growth_weekly"](ledger, period="last_week", as_of=AS_OF)
    yield METRICS["active_users_by_ledger"](ledger, period="last_month", as_of=AS_OF)


def _same_counts(left, right):
    for a, b in zip(_counts(left), _counts(right), strict=True):
        assert a.schema.simpleString() == b.schema.simpleString() and rows_of(a) == rows_of(b)


def test_unions_of_days_count_what_the_facts_have(spark, ledger_of, tmp_path):
    tables = _sample(9)
    for name in ("native_actor", "native_event", "evm_tx"):
        tables[name] += [tables[name][0] | {"block_timestamp": None}]
    ledger = ledger_of(**tables)
    _same_counts(ledger, _with_keys(spark, tmp_path, ledger, [Span()]))


def test_late_rows_of_a_day_change_that_day(spark, ledger_of, tmp_path, days):
    tables = _sample(10)
    early = ledger_of(**{name: rows[40:] for name, rows in tables.items()})
    full = ledger_of(**tables)
    weeks = [Span(days[35].start, days[48].end), Span(days[0].start, days[34].end)]  # not in their order
    kept = _with_keys(spark, tmp_path, early, weeks)
    before = {r["key"]: r["number"] for r in KeyNumbers(spark, f"{tmp_path}/keys/numbers", 3).table("native_account.account").collect()}
    for span in weeks:
        add_day_counts(kept.manifest, full, span)
        add_day_keys(kept.day_keys, full, span)
    after = {r["key"]: r["number"] for r in KeyNumbers(spark, f"{tmp_path}/keys/numbers", 3).table("native_account.account").collect()}
    assert before.items() <= after.items()
    more = Ledger(full.__getitem__, genesis=full.genesis, manifest=kept.manifest, day_keys=kept.day_keys)
    _same_counts(full, more)


def test_day_keys_of_empty_tables(spark, ledger_of, tmp_path):
    ledger = ledger_of()
    _same_counts(ledger, _with_keys(spark, tmp_path, ledger, [Span()]))


def test_numbers_are_given_once(spark, tmp_path):
    numbers = KeyNumbers(spark, str(tmp_path), 4)
    for keys in (range(50), range(30, 300), range(300), []):
        rows = spark.createDataFrame([(f"k{i}",) for i in keys] + [(None,), (None,)], "key string")
        numbers.give("x", rows)
    found = {r["key"]: r["number"] for r in numbers.table("x").collect()}
    assert len(found) == numbers.table("x").count() == len(set(found.values())) == 300
    assert min(found.values()) >= 1 and max(found.values()) < 600


def test_bitmaps_of_more_than_one_run(spark, ledger_of, tmp_path):
    rows = [
        {"tx_hash": f"h{i}", "block_timestamp": at(f"2024-01-{1 + i % 20:02d} 00:00:00"), "from_address": f"0x{i % 40_000}",
         "to_address": "c", "origin_function_signature": "0x12345678"}
        for i in range(50_000)
    ]
    ledger = ledger_of(evm_tx=rows)
    kept = _with_keys(spark, tmp_path, ledger, [Span()], slices=8)
    assert kept.day_keys.days("evm_account", "account").select("run").distinct().count() >= 2
    for period in ("all_time", "last_month"):
        a, b = (METRICS["active_users_by_ledger"](x, period=period, as_of=AS_OF) for x in (ledger, kept))
        assert rows_of(a) == rows_of(b)


@pytest.mark.parametrize("name", [n for n in CHECKS if "__day_keys" in n])
def test_day_keys_read_and_shuffle_no_facts(spark, name):
    plan = _plan(CHECKS[name].run(spark, SMALL))
    scans = re.findall(r"FileScan parquet .*", plan)
    assert scans and all("state-" in s for s in scans) and "Expand" not in plan


@pytest.mark.parametrize("name", [n for n in CHECKS if "__state" in n or "__day_keys" in n])
def test_state_rows_equal_the_rows_of_the_facts(spark, name):
    check = CHECKS[name]
    plain = type(check)(check.metric, check.world, check.period, check.options)
    assert spark_rows(check.run(spark, SMALL)) == spark_rows(plain.run(spark, SMALL))
