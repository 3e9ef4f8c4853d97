"""Pieces of SQL for the oracle, in its dialect."""

CIK = "lpad(nullif(regexp_extract({0}, '0*([0-9]+)', 1), ''), 10, '0')"
CUSIP = "lpad(nullif(upper(translate({0}, ' -.', '')), ''), 9, '0')"
TICKER = "nullif(regexp_replace(upper(replace({0}, ' ', '')), '[.].*$', ''), '')"


def cik(c: str = "cik") -> str:
    return CIK.format(c)


def cusip(c: str = "cusip") -> str:
    return CUSIP.format(c)


def ticker(c: str = "ticker") -> str:
    return TICKER.format(c)
