"""Column expressions used by several operators. All of them stay on the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.config import BENIGN, DAY_SPLIT

# --------------------------------------------------------------------------
# Label needles in the order they are tried, and their family.
# --------------------------------------------------------------------------
LABEL_FAMILIES = (
    ("benign", "BENIGN"),
    ("hulk", "DoS Hulk"),
    ("goldeneye", "DoS GoldenEye"),
    ("slowloris", "DoS slowloris"),
    ("slowhttptest", "DoS Slowhttptest"),
    ("heartbleed", "Heartbleed"),
    ("ftp-patator", "FTP-Patator"),
    ("ssh-patator", "SSH-Patator"),
    ("portscan", "PortScan"),
    ("port scan", "PortScan"),
    ("ddos", "DDoS"),
    ("bot", "Bot"),
    ("brute force", "Web Attack Brute Force"),
    ("brute-force", "Web Attack Brute Force"),
    ("xss", "Web Attack XSS"),
    ("sql injection", "Web Attack SQL Injection"),
    ("sql-injection", "Web Attack SQL Injection"),
    ("infiltration", "Infiltration"),
)

# Address prefixes counted as internal ("172.2" also covers public 172.2.x.x).
INTERNAL_PREFIXES = (
    "192.168.", "10.", "172.16.", "172.17.", "172.18.", "172.19.",
    "172.2", "172.30.", "172.31.",
)


def first_match(cases, otherwise) -> Column:
    """``cases`` = [(condition, value)]; the first true condition wins."""
    chain = None
    for condition, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def attack_family(label: Column) -> Column:
    text = F.trim(F.coalesce(label, F.lit("")))
    low = F.lower(text)
    cases = [(low == "", BENIGN)]
    cases += [(low.contains(needle), family) for needle, family in LABEL_FAMILIES]
    return first_match(cases, text)


def day_name(source: Column) -> Column:
    text = F.lower(source)
    return first_match([(text.contains(d.lower()), d) for d in DAY_SPLIT], "Unknown")


def is_internal(ip: Column) -> Column:
    return reduce(lambda a, b: a | b, [ip.startswith(p) for p in INTERNAL_PREFIXES])


def finite(value: Column) -> Column:
    """Numeric text or number -> double; NaN, infinities and junk -> NULL."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) != F.lit(float("inf"))), number)


def finite_or_zero(value: Column) -> Column:
    return F.coalesce(finite(value), F.lit(0.0))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of an instant (TIMESTAMP) as double."""
    return F.unix_micros(ts) / F.lit(1000000.0)


def clock_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a wall-clock reading taken as UTC, whatever the session zone is."""
    zero = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", zero, ts.cast("timestamp_ntz")) / F.lit(1000000.0)


def log1p_pos(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def sigmoid(score: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-score))


def unit_draw(seed, *parts) -> Column:
    """Uniform draw in [0, 1) that depends only on the seed and the row's keys."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in (seed, *parts)]
    text = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])
    # 13 hex digits are 52 bits, so that the quotient is exact and never reaches 1.
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def number_text(value: Column, digits: int = 2) -> Column:
    """Fixed-point text rounded from the exact binary value; exact halves go to the even digit.

    ``format_string`` alone rounds the shortest decimal text half up (0.625 -> 0.63, 0.145 -> 0.15).
    The value is split in two short halves so that the distance to the midpoint is exact.
    """
    x = value.cast("double")
    m = float(10 ** digits)
    low = F.floor(x * m).cast("double")
    wide = x * 134217729.0
    head = wide - (wide - x)
    off = (head * (2.0 * m) - (low * 2.0 + 1.0)) + (x - head) * (2.0 * m)
    up = (off > 0) | ((off == 0) & (F.pmod(low, F.lit(2.0)) == 1.0))
    return F.format_string(f"%.{digits}f", F.when(up, low + 1.0).otherwise(low) / m)


def percent_text(value: Column, digits: int = 1) -> Column:
    return F.concat(number_text(value.cast("double") * 100.0, digits), F.lit("%"))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where the bottom is 0."""
    return F.when(bottom != 0, top / F.when(bottom != 0, bottom)).otherwise(F.lit(0.0))


def endpoint_key(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """Direction-free 5-tuple: the two ``ip:port`` texts in string order, then the protocol."""
    a = F.concat_ws(":", src_ip.cast("string"), src_port.cast("string"))
    b = F.concat_ws(":", dst_ip.cast("string"), dst_port.cast("string"))
    return F.concat(F.least(a, b), F.lit("<->"), F.greatest(a, b), F.lit(":"), protocol.cast("string"))


def _signed_octets(ip: Column) -> Column:
    return F.transform(
        F.split(ip, r"\."),
        lambda part: F.when(part.cast("int") < 128, part.cast("int")).otherwise(part.cast("int") - 256),
    )


def signed_flow_id(src_ip, src_port, dst_ip, dst_port, protocol) -> Column:
    """Flow id whose endpoint order compares IPv4 octets as signed bytes; equal addresses go by port."""
    a, b = _signed_octets(src_ip), _signed_octets(dst_ip)
    src_first = (a < b) | ((a == b) & (src_port < dst_port))
    forward = F.concat_ws("-", src_ip, dst_ip, src_port.cast("string"), dst_port.cast("string"), protocol.cast("string"))
    reverse = F.concat_ws("-", dst_ip, src_ip, dst_port.cast("string"), src_port.cast("string"), protocol.cast("string"))
    return F.when(src_first, forward).otherwise(reverse)
