"""Small literal fact tables."""

from peerlens.roles import Roles

PEERS = {"P1": 400.0, "P2": 100.0, "P3": 90.0, "P4": 80.0, "P5": 60.0, "P6": 40.0}
MONTHS = ("2024-01", "2024-02")


def facts(spark):
    """A target and six peers, two dimensions, two months; P1 dominates online."""
    rows = []
    for month_no, month in enumerate(MONTHS):
        for peer, base in {**PEERS, "Target": 120.0}.items():
            for card, part in (("CREDIT", 0.6), ("DEBIT", 0.4)):
                for channel, boost in (("online", 1.5 if peer == "P1" else 1.0), ("store", 1.0)):
                    n = base * part * boost * (1 + month_no)
                    rows.append((peer, month, card, channel, n, n * 2, n * 1.8, n * 0.02))
    return spark.createDataFrame(
        rows,
        "issuer string, month string, card string, channel string, "
        "txn double, total double, approved double, fraud double",
    )


SHARE = Roles("issuer", ("card", "channel"), metric="txn", target="Target")
TIMED = Roles("issuer", ("card", "channel"), metric="txn", time="month", target="Target")
RATE = Roles(
    "issuer",
    ("card", "channel"),
    total="total",
    numerators={"approval": "approved", "fraud": "fraud"},
    time="month",
    target="Target",
)


def rows_of(df, *keys):
    """Rows as a dict keyed by the given columns."""
    return {tuple(r[k] for k in keys): r for r in df.collect()}
