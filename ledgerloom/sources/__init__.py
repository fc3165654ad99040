from ledgerloom.sources.layout import save_bucketed, write_by_day
from ledgerloom.sources.ledger import Ledger
from ledgerloom.sources.market import market_points, read_market_chart
from ledgerloom.sources.schemas import FACT_TABLES, TABLES, parse_event_data
from ledgerloom.sources.state import DayKeys, DayManifest, FirstSeen, add_first_seen

__all__ = [
    "FACT_TABLES",
    "TABLES",
    "DayKeys",
    "DayManifest",
    "FirstSeen",
    "Ledger",
    "add_first_seen",
    "market_points",
    "parse_event_data",
    "read_market_chart",
    "save_bucketed",
    "write_by_day",
]
