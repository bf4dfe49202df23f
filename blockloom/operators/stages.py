"""The stages of the format as relational queries over short values.

Each function gives SQL for a dialect, so that the same definition runs on Spark and on another engine. The input is a view
or subquery `t` with columns k (key) and x (text); what comes out is rows, one for each byte, run, rotation or symbol.
Sorting rotations this way takes memory with the square of a value's length: for names, not for blocks of 900 kB.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Dialect:
    name: str

    def digits(self, x: str) -> str:
        """Two hexadecimal digits for each byte of a text; their order is that of the bytes."""
        return f"hex(encode({x}, 'utf-8'))" if self.name == "spark" else f"hex(encode({x}))"

    def each(self, n: str) -> str:
        """A lateral join with i from 0 to n - 1."""
        return f", LATERAL explode(sequence(0, {n} - 1)) AS e(i)" if self.name == "spark" else f", LATERAL (SELECT unnest(range(0, {n})) AS i) AS e"

    def number(self, digits: str) -> str:
        return f"CAST(conv({digits}, 16, 10) AS INT)" if self.name == "spark" else f"CAST(('0x' || {digits}) AS INT)"

    def binary(self, n: str) -> str:
        return f"bin({n})"


SPARK, DUCK = Dialect("spark"), Dialect("duckdb")


def hexed(d: Dialect, t: str) -> str:
    return f"h AS (SELECT k, {d.digits('x')} AS hx, CAST(length({d.digits('x')}) / 2 AS INT) AS n FROM {t})"


def byte_rows(d: Dialect, t: str) -> str:
    return f"{hexed(d, t)}, b AS (SELECT k, n, i AS p, substr(hx, 2 * i + 1, 2) AS b FROM h{d.each('n')} WHERE n > 0)"


def run_rows(d: Dialect, t: str) -> str:
    """r: k, run (from 0), b, p (where it starts), len."""
    return f"""{byte_rows(d, t)},
m AS (SELECT k, p, b, CASE WHEN b = lag(b) OVER (PARTITION BY k ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM b),
g AS (SELECT k, p, b, sum(fresh) OVER (PARTITION BY k ORDER BY p) - 1 AS run FROM m),
r AS (SELECT k, CAST(run AS INT) AS run, b, CAST(min(p) AS INT) AS p, CAST(count(*) AS INT) AS len FROM g GROUP BY k, run, b)"""


def rle1_runs(d: Dialect, t: str) -> str:
    return f"""WITH {run_rows(d, t)}
SELECT k, run, b AS byte, p AS start, len, CASE WHEN len >= 4 THEN 5 ELSE len END AS coded FROM r"""


def rotations(d: Dialect, t: str) -> str:
    return f"""{hexed(d, t)},
rot AS (SELECT k, n, hx, i, substr(hx, 2 * i + 1) || substr(hx, 1, 2 * i) AS rot FROM h{d.each('n')} WHERE n > 0),
s AS (SELECT k, n, hx, i, rot, CAST(row_number() OVER (PARTITION BY k ORDER BY rot, i) - 1 AS INT) AS place FROM rot)"""


def bwt_column(d: Dialect, t: str) -> str:
    return f"WITH {rotations(d, t)}\nSELECT k, place AS p, substr(rot, 2 * n - 1, 2) AS byte FROM s"


def bwt_origin(d: Dialect, t: str) -> str:
    return f"WITH {rotations(d, t)}\nSELECT k, n, place AS origin FROM s WHERE i = 0"


def least_rotation(d: Dialect, t: str) -> str:
    return f"WITH {rotations(d, t)}\nSELECT k, i AS start, rot AS rotation FROM s WHERE place = 0"


def exact_period(d: Dialect, t: str) -> str:
    return f"""WITH {rotations(d, t)},
q AS (SELECT k, n, min(CASE WHEN i > 0 AND rot = hx THEN i END) AS again FROM s GROUP BY k, n)
SELECT k, CAST(coalesce(again, n) AS INT) AS period, again IS NOT NULL AS repeats FROM q"""


def mtf_rows(d: Dialect, t: str) -> str:
    """f: k, p, b, pos: how many distinct bytes came since the same byte; if never, all seen and the smaller ones unseen."""
    return f"""{rotations(d, t)},
c AS (SELECT k, place AS p, substr(rot, 2 * n - 1, 2) AS b FROM s),
l AS (SELECT k, p, b, lag(p) OVER (PARTITION BY k, b ORDER BY p) AS prev, min(p) OVER (PARTITION BY k, b) AS first FROM c),
f AS (SELECT l.k, l.p, l.b, CAST(CASE WHEN l.prev IS NOT NULL
    THEN count(DISTINCT CASE WHEN o.p > l.prev AND o.p < l.p THEN o.b END)
    ELSE count(DISTINCT CASE WHEN o.p < l.p OR o.b < l.b AND o.first >= l.p THEN o.b END) END AS INT) AS pos
    FROM l JOIN l AS o ON l.k = o.k GROUP BY l.k, l.p, l.b, l.prev)"""


def mtf_positions(d: Dialect, t: str) -> str:
    return f"WITH {mtf_rows(d, t)}\nSELECT k, p, b AS byte, pos FROM f"


def symbol_rows(d: Dialect, t: str) -> str:
    """y: k, p (where the symbol's first position stands), digit, symbol."""
    return f"""{mtf_rows(d, t)},
z AS (SELECT k, p, pos, CASE WHEN pos = 0 AND lag(pos) OVER (PARTITION BY k ORDER BY p) = 0 THEN 0 ELSE 1 END AS fresh FROM f),
w AS (SELECT k, p, pos, sum(fresh) OVER (PARTITION BY k ORDER BY p) AS run FROM z),
u AS (SELECT k, min(p) AS p, max(pos) AS pos, count(*) AS len FROM w GROUP BY k, run),
v AS (SELECT k, p, pos, CASE WHEN pos = 0 THEN reverse(substr({d.binary('len + 1')}, 2)) ELSE '1' END AS digits FROM u),
a AS (SELECT k, count(DISTINCT b) AS used, max(p) + 1 AS n FROM f GROUP BY k),
y AS (SELECT k, p, i AS digit, CASE WHEN pos = 0 THEN CAST(substr(digits, i + 1, 1) AS INT) ELSE pos + 1 END AS symbol
    FROM v{d.each('CAST(length(digits) AS INT)')}
    UNION ALL SELECT k, n, 0, CAST(used + 1 AS INT) FROM a)"""


def zrle_symbols(d: Dialect, t: str) -> str:
    return f"WITH {symbol_rows(d, t)}\nSELECT k, CAST(p AS INT) AS p, CAST(digit AS INT) AS digit, CAST(symbol AS INT) AS symbol FROM y"


def symbol_histogram(d: Dialect, t: str) -> str:
    return f"WITH {symbol_rows(d, t)}\nSELECT CAST(symbol AS INT) AS symbol, count(*) AS n FROM y GROUP BY symbol"


def table_count(d: Dialect, t: str) -> str:
    """t: k, n (symbols)."""
    steps = " ".join(f"WHEN n < {x} THEN {k}" for x, k in ((200, 2), (600, 3), (1200, 4), (2400, 5)))
    return f"SELECT k, CASE {steps} ELSE 6 END AS tables FROM {t}"


def canonical_codes(d: Dialect, t: str) -> str:
    """t: k, symbol, len. A code is the sum of what all codes before it take, in units of its own length."""
    return f"""SELECT k, symbol, len, CAST(floor(coalesce(sum(power(2.0, -len)) OVER (PARTITION BY k ORDER BY len, symbol
ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * power(2.0, len)) AS BIGINT) AS code FROM {t}"""


def output_names(d: Dialect, t: str) -> str:
    """t: k, x. Names that compression and decompression write; what has a known suffix is not compressed again. A name that is a suffix alone has none."""
    ends = {s: f"(x LIKE '%_{s}' AND x NOT LIKE '%/{s}')" for s in (".bz2", ".bz", ".tbz2", ".tbz")}
    cases = " ".join(f"WHEN {ends[s]} THEN substr(x, 1, length(x) - {len(s)}) || '{'.tar' * ('t' in s)}'" for s in ends)
    return f"""SELECT k, x, CASE WHEN {' OR '.join(ends.values())} THEN NULL ELSE x || '.bz2' END AS packed,
CASE {cases} ELSE x || '.out' END AS unpacked FROM {t}"""


def exit_codes(d: Dialect, t: str) -> str:
    """t: k, error. 2 for damaged data, 1 for any other trouble, and the worst of all files of a key."""
    return f"SELECT k, max(CASE WHEN error IS NULL THEN 0 WHEN error = 'Io' THEN 1 ELSE 2 END) AS exit_code FROM {t} GROUP BY k"
