"""SQL of the catalogue's queries that need recursion, transforms or least squares."""

from __future__ import annotations

from ..operators import registry, sequential, spectral, windows
from .catalog import DFT, ORACLE_SQL, A, S, primed

RECURSIVE = S.replace("WITH", "WITH RECURSIVE")
#: click with view as the wanted signal.
TWO = f"{RECURSIVE}, q AS MATERIALIZED (SELECT a.idx, a.value AS v, b.value AS d FROM s a JOIN s b ON a.idx = b.idx AND a.trace = 'click' AND b.trace = 'view')"


def _auto_range() -> str:
    out = lambda x, f: f"CASE WHEN {x} = 0 THEN 0.0 ELSE round({f}({x} / pow(10.0, floor(log10(abs({x}))) - 1)) * pow(10.0, floor(log10(abs({x}))) - 1), 6) END"
    return f"{S}, r AS (SELECT trace, min(value) - (max(value) - min(value)) * 0.1 AS lo, max(value) + (max(value) - min(value)) * 0.1 AS hi FROM s GROUP BY trace) SELECT trace, {out('lo', 'floor')} AS low, {out('hi', 'ceil')} AS high FROM r"


TO_UNIFORM = f"""{S}, u AS (SELECT trace, idx, idx + (event_id % 3) * 0.1::DOUBLE AS t, value FROM s), g AS (SELECT trace, idx, t, value, t - lag(t) OVER w AS gap, lead(t) OVER w AS x1, lead(value) OVER w AS y1 FROM u WINDOW w AS (PARTITION BY trace ORDER BY idx)),
i AS (SELECT trace, 1 / min(CASE WHEN gap > 0 THEN gap END) AS sps, min(t) AS t0, max(t) AS t1, max(idx) AS top FROM g GROUP BY trace),
b AS (SELECT g.*, sps, t0, floor((t1 - t0) * sps + 1)::BIGINT AS n, CASE WHEN idx = 0 THEN 0 ELSE floor((t - 0.25 / sps - t0) * sps)::BIGINT + 1 END AS lo, floor((x1 - 0.25 / sps - t0) * sps)::BIGINT + 1 AS nxt, idx = top - 1 AS final FROM g JOIN i USING (trace) WHERE x1 IS NOT NULL),
p AS (SELECT *, unnest(range(lo, CASE WHEN final THEN n ELSE least(nxt, n) END)) AS i FROM b)
SELECT trace, i, round(CASE WHEN i = lo AND idx > 0 THEN value ELSE value + (y1 - value) * (t0 + i / sps - t) / (x1 - t) END, 6) AS value FROM p"""


def bessel(name: str) -> str:
    """Recursion over the four sections: each has its last two inner values as state."""
    parts = sequential.BESSEL_SECTIONS
    steps, x = [], f"({sequential.BESSEL_GAIN!r} * q.value)"
    for i, (p, q, m) in enumerate(parts):
        steps.append(f"{x} + ({p!r}) * f.a{i} + ({q!r}) * f.b{i} AS w{i}")
        steps.append(f"w{i} + ({m!r}) * f.a{i} + f.b{i} AS y{i}")
        x = f"y{i}"
    zeros = ", ".join(f"0.0::DOUBLE AS a{i}, 0.0::DOUBLE AS b{i}" for i in range(len(parts)))
    cols = ", ".join(f"a{i}, b{i}" for i in range(len(parts)))
    wanted = ", ".join(f"w{i}, a{i}" for i in range(len(parts)))
    return f"""{name} AS (SELECT trace, -1::BIGINT AS idx, 0.0::DOUBLE AS out, {zeros} FROM (SELECT DISTINCT trace FROM s)
UNION ALL SELECT trace, idx, {x}, {wanted} FROM (SELECT q.trace, q.idx, {", ".join(f"f.{c}" for c in cols.split(", "))}, {", ".join(steps)} FROM {name} f JOIN q ON q.trace = f.trace AND q.idx = f.idx + 1))"""


IIR = f"{RECURSIVE}, q AS MATERIALIZED (SELECT trace, idx, value FROM s), {bessel('z')} SELECT trace, idx, round(out, 4) AS out FROM z WHERE idx >= 0"


def weighting_sql(kind: str, hz: str) -> str:
    """Share of a frequency, by the four (A) or two (C) pole frequencies of the standard, over that of 1 kHz."""

    def raw(f2: str) -> str:
        ends = f"({f2} * 12194.0 * 12194.0 / (({f2} + 20.6 * 20.6) * ({f2} + 12194.0 * 12194.0)))"
        return f"{ends} * {f2} / sqrt(({f2} + 107.7 * 107.7) * ({f2} + 737.9 * 737.9))" if kind == "A" else ends

    return f"({raw(f'({hz} * {hz})::DOUBLE')}) / ({raw('1000000::DOUBLE')})"


#: Taps by their formulas: means, delays, windowed sincs and what they leave, a weighting's impulse answer, a cubic at its middle.
TAPS_SQL = f"""k AS (SELECT unnest(range(63)) AS k),
lp AS (SELECT cut, k, h / sum(h) OVER (PARTITION BY cut) AS h FROM (SELECT cut, k, CASE WHEN k = 31 THEN 2 * cut ELSE sin(2 * pi() * cut * (k - 31)) / (pi() * (k - 31)) END * (0.54 - 0.46 * cos(2 * pi() * k / 62)) AS h FROM k, (SELECT unnest([0.1, 0.08, 0.12]::DOUBLE[]) AS cut))),
aw AS (SELECT b, {weighting_sql("A", "(b * 375.0)")} AS g FROM (SELECT unnest(range(65)) AS b)),
sg AS (SELECT k, x, sum(x * x) OVER () AS m2, sum(x * x * x * x) OVER () AS m4 FROM (SELECT k, (k - 4.5)::DOUBLE AS x FROM k WHERE k < 10)),
taps AS (SELECT 'Box 10' AS filter, k - 4 AS ahead, 5 AS half, 0.1::DOUBLE AS tap FROM k WHERE k < 10
UNION ALL SELECT 'Delay 5', k - 2, 3, CASE WHEN k = 0 THEN 1 ELSE 0 END::DOUBLE FROM k WHERE k < 6
UNION ALL SELECT 'Lpf 0.1', k - 31, 31, h FROM lp WHERE cut = 0.1
UNION ALL SELECT 'Hpf 0.1', k - 31, 31, CASE WHEN k = 31 THEN 1 ELSE 0 END - h FROM lp WHERE cut = 0.1
UNION ALL SELECT 'Notch 0.1', k - 31, 31, a.h + CASE WHEN k = 31 THEN 1 ELSE 0 END - b.h FROM lp a JOIN lp b USING (k) WHERE a.cut = 0.08 AND b.cut = 0.12
UNION ALL SELECT 'A 48k', j - 31, 32, sum(g * CASE WHEN b IN (0, 64) THEN 1 ELSE 2 END * cos(2 * pi() * b * (j - 32) / 128)) / 128 FROM aw, (SELECT unnest(range(64)) AS j) GROUP BY j
UNION ALL SELECT 'SG 10/3', k - 9, 0, (m4 - m2 * x * x) / (10 * m4 - m2 * m2) FROM sg)"""


def _named_filters() -> str:
    return f"""{RECURSIVE}, q AS MATERIALIZED (SELECT trace, idx, value, count(*) OVER (PARTITION BY trace) AS n FROM s), {TAPS_SQL},
fir AS (SELECT filter, a.trace, a.idx, sum(tap * b.value) AS out, any_value(a.n) AS n, any_value(half) AS half FROM (SELECT q.*, taps.*, greatest(0, least(n - 1, idx + ahead)) AS place FROM q, taps) a JOIN q b ON b.trace = a.trace AND b.idx = a.place GROUP BY ALL),
{bessel("z")}
SELECT filter, trace, idx, CASE WHEN filter LIKE 'SG%' THEN round(o, 9) ELSE round(o, 6) END + 0.0 AS out FROM (SELECT *, CASE WHEN n >= half THEN out ELSE 0 END AS o FROM fir)
UNION ALL SELECT 'RMS 100', trace, idx, round(sqrt({primed("value * value", 100)}), 6) FROM s
UNION ALL SELECT 'Bessel', trace, idx, round(out, 4) + 0.0 FROM z WHERE idx >= 0"""


DOT = "list_sum(list_transform(list_zip({}, {}), lambda p: p[1] * p[2]))"


def adaptive(rate: str, learns: str, out: str, more: str = "", more_first: str = "", more_next: str = "") -> str:
    """Taps w over history h: one step of learning a row."""
    new = "CASE WHEN f.idx < 0 THEN list_transform(range(8), lambda i: q.v) ELSE list_append(f.h[2:], q.v) END"
    return f"""{TWO}, f AS (SELECT -1::BIGINT AS idx, list_transform(range(8), lambda i: 0.0::DOUBLE) AS w, list_transform(range(8), lambda i: 0.0::DOUBLE) AS h, 0.0::DOUBLE AS out{more_first}
UNION ALL SELECT idx, CASE WHEN {learns} THEN list_transform(list_zip(w, h), lambda p: p[1] + ({rate}) * p[2]) ELSE w END, h, {out}{more_next} FROM (
  SELECT *, {DOT.format("w", "h")} AS y, {DOT.format("h", "h")} AS power FROM (SELECT q.idx, q.v, q.d, f.w, {new} AS h{more} FROM f JOIN q ON q.idx = f.idx + 1)))
SELECT 'click' AS trace, idx, round(out, 6) AS out FROM f WHERE idx >= 0"""


NLMS = adaptive("0.5 * (d - y) / (power + 1e-7)", "true", "y")
ECHO = adaptive("0.5 * (d - y) / (power / 8 * 8 + 1e-7)", "power / 8 > 1e-6 AND near < 4 * (power / 8)", "d - y", ", f.near + 0.1 * (q.d * q.d - f.near) AS near", ", 0.0::DOUBLE AS near", ", near")

RLS = f"""{TWO}, f AS (SELECT -1::BIGINT AS idx, list_transform(range(8), lambda i: 0.0::DOUBLE) AS w, list_transform(range(8), lambda i: 0.0::DOUBLE) AS h,
  list_transform(range(8), lambda i: list_transform(range(8), lambda j: CASE WHEN i = j THEN 50.0 ELSE 0.0 END::DOUBLE)) AS p, 0.0::DOUBLE AS out
UNION ALL SELECT idx, list_transform(list_zip(w, g), lambda z: z[1] + z[2] * (d - y)), h, list_transform(list_zip(p, g), lambda z: list_transform(list_zip(z[1], px), lambda u: u[1] - z[2] * u[2])), y FROM (
  SELECT *, list_transform(px, lambda x: x / (1 + {DOT.format("h", "px")})) AS g FROM (
    SELECT *, {DOT.format("w", "h")} AS y, list_transform(p, lambda row: {DOT.format("row", "h")}) AS px FROM (
      SELECT q.idx, q.v, q.d, f.w, f.p, CASE WHEN f.idx < 0 THEN list_transform(range(8), lambda i: q.v) ELSE list_append(f.h[2:], q.v) END AS h FROM f JOIN q ON q.idx = f.idx + 1))))
SELECT 'click' AS trace, idx, round(out, 4) AS out FROM f WHERE idx >= 0"""


def _kalman() -> str:
    """Both dimensions are alike and don't meet: state x, v and its covariance, from rest."""
    cols = ("x", "v", "a", "b", "c", "e")
    first = ", ".join(f"0.0::DOUBLE AS {c}{i}" for i in (0, 1) for c in cols)
    gain, after, ahead = [], [], []
    for i, z in ((0, "z0"), (1, "z1")):
        gain.append(f"a{i} / (a{i} + 10.0) AS k{i}, c{i} / (a{i} + 10.0) AS l{i}")
        after.append(f"x{i} + k{i} * ({z} - x{i}) AS x{i}, v{i} + l{i} * ({z} - x{i}) AS v{i}, a{i} - k{i} * a{i} AS a{i}, b{i} - k{i} * b{i} AS b{i}, c{i} - l{i} * a{i} AS c{i}, e{i} - l{i} * b{i} AS e{i}")
        ahead.append(f"x{i} + v{i}, v{i}, a{i} + b{i} + c{i} + e{i} + 0.025, b{i} + e{i} + 0.05, c{i} + e{i} + 0.05, e{i} + 0.05")
    state = ", ".join(f"f.{c}{i}" for i in (0, 1) for c in cols)
    return f"""{TWO}, f AS (SELECT -1::BIGINT AS idx, 0.0::DOUBLE AS ox, 0.0::DOUBLE AS oy, {first}
UNION ALL SELECT idx, x0, x1, {", ".join(ahead)} FROM (SELECT idx, {", ".join(after)} FROM (SELECT *, {", ".join(gain)} FROM (SELECT q.idx, q.v AS z0, q.d AS z1, {state} FROM f JOIN q ON q.idx = f.idx + 1))))
SELECT 'click' AS trace, idx, round(ox, 6) AS x, round(oy, 6) AS y FROM f WHERE idx >= 0"""


PID = f"""{TWO}, f AS (SELECT -1::BIGINT AS idx, 0.0::DOUBLE AS total, NULL::DOUBLE AS last, 0.0::DOUBLE AS slope, 0.0::DOUBLE AS out
UNION ALL SELECT idx, total, e, slope, greatest(-100.0, least(100.0, 0.5 * e + total + 0.05 * slope)) FROM (SELECT idx, e, greatest(-100.0, least(100.0, total + 0.1 * e)) AS total, coalesce(e - last, 0) AS slope FROM (SELECT q.idx, q.d - q.v AS e, f.total, f.last FROM f JOIN q ON q.idx = f.idx + 1)))
SELECT 'click' AS trace, idx, round(out, 6) AS out FROM f WHERE idx >= 0"""


def _shaped() -> str:
    import numpy as np

    n = 33
    shapes = {
        "band": spectral.band_pass_3db(n, 4.0, 12.0, "RaisedCosine"), "notch": spectral.notch_3db(n, 4.0, 12.0, "RaisedCosine"), "low": spectral.low_pass(n, 0.7071, 8.0, 0.5, 10.0, "RaisedCosine"),
        "high": spectral.high_pass(n, 0.5, 8.0, 0.7071, 10.0, "RaisedCosine"), "A": spectral.weighting("A", np.arange(n) * 625.0), "curve": spectral.arbitrary(n, 40000.0, [(20.0, -50.0), (1000.0, 0.0), (20000.0, -9.0)]),
    }
    gains = ", ".join(f"('{k}', {j}, {float(g)!r}::DOUBLE)" for k, v in shapes.items() for j, g in enumerate(v))
    return f"""{DFT}, g AS (SELECT * FROM (VALUES {gains}) AS v(shape, k, gain)),
t AS (SELECT shape, z.trace, i, sum(gain * CASE WHEN z.k IN (0, 32) THEN 1 ELSE 2 END * (re * cos(2 * pi() * i * z.k / 64) - im * sin(2 * pi() * i * z.k / 64))) AS value FROM z JOIN g ON g.k = z.k, (SELECT unnest(range(64)) AS i) GROUP BY ALL)
SELECT shape, trace, i::INTEGER AS idx, round(value, 6) AS value FROM t"""


def dft(source: str, width: int, top: int) -> str:
    """Bins up to top of the transform over its length of frames (trace, frame, place, v)."""
    return f"SELECT trace, frame, k, sum(v * cos(-2 * pi() * place * k / {width})) / {width} AS re, sum(v * sin(-2 * pi() * place * k / {width})) / {width} AS im FROM {source}, (SELECT unnest(range({top + 1})) AS k) GROUP BY ALL"


OVERLAP = f"""{S}, f AS (SELECT trace, idx, fr AS frame, idx + 64 - fr * 64 AS place, value FROM (SELECT *, unnest([(idx + 64) // 64 - 1, (idx + 64) // 64]) AS fr FROM s) WHERE fr >= 0),
w AS (SELECT trace, frame, place, value * sqrt(0.5 * (1 - cos(place / 128.0::DOUBLE * pi() * 2))) AS v FROM f), z AS ({dft("w", 128, 16)}),
b AS (SELECT trace, frame, place, sum(CASE WHEN k = 0 THEN 1 ELSE 2 END * (re * cos(2 * pi() * place * k / 128) - im * sin(2 * pi() * place * k / 128))) AS v FROM z, (SELECT unnest(range(128)) AS place) GROUP BY ALL),
o AS (SELECT trace, frame * 64 + place - 64 AS idx, sum(v * sqrt(0.5 * (1 - cos(place / 128.0::DOUBLE * pi() * 2)))) AS out FROM b GROUP BY ALL) SELECT s.trace, s.idx, round(out, 6) AS out FROM s JOIN o USING (trace, idx)"""

SPECTROGRAM = f"""{S}, f AS (SELECT trace, fr AS frame, idx - fr * 32 AS place, value AS v, count(*) OVER (PARTITION BY trace, fr) AS n FROM (SELECT *, unnest([idx // 32 - 1, idx // 32]) AS fr FROM s) WHERE fr >= 0),
w AS (SELECT * FROM f WHERE n = 64), z AS ({dft("w", 64, 32)}), m AS (SELECT *, sqrt(re * re + im * im) AS m FROM z)
SELECT trace, frame, k::INTEGER AS bin, round(CASE WHEN m > 0 THEN least(greatest(10 * log10(m), -200), 100) ELSE -200 END, 6) AS db FROM m"""


def polynomial(source: str, by: str, x: str) -> str:
    """Least squares of order 5 by orthogonal polynomials, each made from the two before it; a group with no more samples than an order stops there."""
    out = f"p0 AS (SELECT *, CASE WHEN n > 1 THEN 2.0::DOUBLE * {x} / (n - 1) - 1 ELSE 0.0::DOUBLE END AS u, 1.0::DOUBLE AS p0 FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM {source}))"
    dot = lambda e: f"sum({e}) OVER (PARTITION BY {by})"
    for k in range(5):
        last = f" - p{k - 1} * {dot(f'p{k} * p{k}')} / {dot(f'p{k - 1} * p{k - 1}')}" if k else ""
        out += f", p{k + 1} AS (SELECT *, CASE WHEN n > {k + 1} THEN (u - {dot(f'u * p{k} * p{k}')} / {dot(f'p{k} * p{k}')}) * p{k}{last} END AS p{k + 1} FROM p{k})"
    fit = " + ".join(f"coalesce(p{k} * {dot(f'value * p{k}')} / {dot(f'p{k} * p{k}')}, 0)" for k in range(6))
    return out + f", fit AS (SELECT *, {fit} AS out FROM p5)"


POLY = f"{S}, c AS (SELECT trace, idx, value FROM s WHERE trace = 'click'), {polynomial('c', 'trace', 'idx')} SELECT trace, idx, round(out, 6) AS out FROM fit"
POLY_FRAMES = f"{S}, c AS (SELECT trace, idx // 200 AS frame, idx % 200 AS place, value FROM s), {polynomial('c', 'trace, frame', 'place')} SELECT trace, frame, place::INTEGER AS place, round(out, 6) AS value FROM fit"

SWEEP = """WITH i AS (SELECT unnest(range(10000)) AS i), p AS (SELECT i, i // 2500 AS turn, i % 2500 AS u FROM i)
SELECT 'sweep' AS trace, i AS idx, round(sin(2 * pi() * ((turn * (1000.0 * 2500 + 1000.0 * 2500 / 2) + 1000.0 * u + 1000.0 * u * u / 5000) / 10000)), 6) AS value FROM p"""

INVERSE = f"""{A}, d AS (SELECT vec_id, a, a[1] * a[4] - a[2] * a[3] AS det FROM e)
SELECT vec_id, round(a[4] / det, 4) AS m00, round(-a[2] / det, 4) AS m01, round(-a[3] / det, 4) AS m10, round(a[1] / det, 4) AS m11 FROM d"""

CHECKSUMS = """WITH c AS (SELECT c_custkey, c_mktsegment, list_transform(string_split(c_name, ''), lambda x: ascii(x)::BIGINT) AS b FROM customer),
t AS (SELECT *, flatten(list_transform(b, lambda x: list_transform(range(8), lambda i: (x >> i) & 1))) AS up, flatten(list_transform(b, lambda x: list_transform(range(8), lambda i: (x >> (7 - i)) & 1))) AS down FROM c)
SELECT c_custkey, xor(list_reduce(list_concat([4294967295::BIGINT], up), lambda c, b: xor(c >> 1, CASE WHEN (c & 1) <> b THEN 3988292384::BIGINT ELSE 0 END)), 4294967295::BIGINT) AS crc32,
list_reduce(list_concat([0::BIGINT], down), lambda c, b: xor((c << 1) & 65535, CASE WHEN (c >> 15) <> b THEN 4129::BIGINT ELSE 0 END))::INTEGER AS crc16, (len(regexp_replace(upper(c_mktsegment), '[^A-Z2-7]', '', 'g')) * 5 // 8)::INTEGER AS base32 FROM t"""

STREAM_LOW_PASS = """WITH RECURSIVE q AS MATERIALIZED (SELECT event_type AS trace, event_id AS idx, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
f AS (SELECT trace, idx, k, value, value AS out FROM q WHERE k = 1 UNION ALL SELECT q.trace, q.idx, q.k, q.value, f.out + (q.value - f.out) * 0.25 FROM f JOIN q ON q.trace = f.trace AND q.k = f.k + 1)
SELECT trace, idx, value, round(out, 9) AS out FROM f"""

ORACLE_SQL |= {
    "auto_range": _auto_range(), "to_uniform": TO_UNIFORM, "iir_band_pass": IIR, "named_filters": _named_filters(), "nlms": NLMS, "echo_cancel": ECHO, "rls": RLS, "kalman": _kalman(), "pid": PID, "fft_shaped_filters": _shaped(), "overlap_add": OVERLAP,
    "spectrogram": SPECTROGRAM, "calc_polyfilter": POLY, "poly_filter": POLY_FRAMES, "sweep": SWEEP, "matrix_inverse": INVERSE, "checksums": CHECKSUMS, "stream_low_pass": STREAM_LOW_PASS,
}
