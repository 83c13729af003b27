from pyspark.sql import Column, functions as F


def address(n) -> Column:
    """Wallet address of an integer id: '0x' + 40 lower-case hex digits."""
    n = F.col(n) if isinstance(n, str) else n
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n.cast("bigint"))), 40, "0"))
