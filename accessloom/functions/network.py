"""Column expressions over IPv4 addresses and region strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNRESOLVED = "0"


_QUAD = r"^\d{1,3}+\.\d{1,3}+\.\d{1,3}+\.\d{1,3}+$"


def ip_to_long(ip: Column) -> Column:
    """Dotted quad to its number; NULL for anything else, short forms included."""
    octets = F.split(ip, r"\.")
    a, b, c, d = (F.get(octets, F.lit(i)).try_cast("bigint") for i in range(4))
    return F.when(
        F.rlike(ip, F.lit(_QUAD)) & (F.greatest(a, b, c, d) <= 255),
        a * 16777216 + b * 65536 + c * 256 + d,
    )


def region_parts(region: Column, city_id: Column) -> dict[str, Column]:
    """Columns of ``country|area|province|city|isp``; ``0`` throughout if it is unknown.

    Counted from the end except for the country, so longer strings work too; a string
    of fewer than three pieces has no province and is unknown as a whole.
    """
    pieces = F.split(region, r"\|")
    known = F.size(pieces) >= 3
    zero = F.lit(UNRESOLVED)

    def piece(i):
        return F.when(known, F.try_element_at(pieces, F.lit(i))).otherwise(zero)

    return {
        "isp": piece(-1),
        "city": piece(-2),
        "city_id": F.when(known, F.coalesce(city_id, F.lit(0))).otherwise(F.lit(0)).cast("int"),
        "province": piece(-3),
        "country": piece(1),
    }
