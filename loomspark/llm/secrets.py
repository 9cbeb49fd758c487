"""Secret scans: fixed patterns, and a battery of randomness tests under false-discovery control.

Only DataFrame and SQL functions run here. Texts without a match cost one search for each pattern;
places come from the lengths of the parts that ``split`` leaves between matches.

The battery looks at runs of 20 and more characters of an encoding's alphabet with a digit among them. Each
candidate's encoding is inferred from its characters (hex in either case, base32, lower or upper
alphanumeric, alphanumeric, base64). The null hypothesis is that it is text or a pattern. Three statistics speak against it:

* chi-squared distance from a uniform alphabet. Under the null hypothesis letters are uneven by at least
  ``n * unevenness`` and the distance is non-central, so a small one has a small p-value, and the smaller the longer the candidate;
* runs above and below the alphabet's middle, and
* the serial correlation of neighbours. Under the null hypothesis either is ``DEPENDENCE * sqrt(n)`` deviations off at least.

What is uneven, or in runs, or correlated isn't random, so the null hypothesis has three ways to hold, and the largest of the three
p-values speaks against all of them (an intersection-union test). Over the whole table the p-values, weighted by length,
pass the Benjamini-Hochberg step-up at ``RATE``: a first pass counts them in ``BINS`` bins of their logarithm, a fixed number of rows
whatever the table, and the largest bin edge that keeps the rate decides in the second pass. Digits alone are no candidate: numbers
aren't credentials.

Null texts are empty ones; repeated rows give repeated rows; long texts and tokens are taken whole. A table without
candidates has no spans of the battery. A kept column that has the name of a result is replaced by it; ``redact`` keeps all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import documents, running

# Fixed patterns
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A match of ``AKIA[A-Z0-9]+`` of 20 or more characters, and a run of hex digits of 24 or more: both
#: patterns take whole runs, so leaving out the short ones afterwards is the same.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

LEAST_VALUE = 6
RATE = 0.05
#: Chance that two letters of text are the same, at least, and how uneven a short alphabet is used in it, at least: ``k`` times the sum of the
#: squared shares, less one. Neighbours in runs or correlated are so by this much.
SAME_LETTER, LEAST_UNEVEN, DEPENDENCE = 0.06, 0.8, 0.8
#: Length of weight one, and the bins of p-values: ``PER_DECADE`` to a power of ten.
MIDDLE, BINS, PER_DECADE = 32, 400, 20

#: (name, characters, alphabet), the narrowest first.
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567"),
    ("lower", "^[a-z0-9]+$", _DIGITS + _LOWER),
    ("upper", "^[A-Z0-9]+$", _DIGITS + _UPPER),
    ("alnum", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", "^.+$", _UPPER + _LOWER + _DIGITS + "-_+/"),
)

_SPAN = "array<struct<start:int,end:int,kind:int,token:string>>"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _matches(df: DataFrame, name: str, pattern: str, kind: int, value: int = 0) -> DataFrame:
    """Adds ``name``: the pattern's matches with their places in code points."""
    found, parts, values = f"_{name}_m", f"_{name}_p", f"_{name}_v"
    df = df.withColumn(found, F.expr(f"CASE WHEN text RLIKE {_q(pattern)} THEN regexp_extract_all(text, {_q(pattern)}, 0) ELSE array() END"))
    df = df.withColumn(parts, F.expr(f"CASE WHEN size({found}) > 0 THEN split(text, {_q(pattern)}, -1) ELSE array() END"))
    df = df.withColumn(values, F.expr(f"CASE WHEN size({found}) > 0 THEN regexp_extract_all(text, {_q(pattern)}, {value}) ELSE array() END") if value else F.col(found))
    steps, starts = f"_{name}_s", f"_{name}_at"
    df = df.withColumn(steps, F.expr(f"transform({found}, (m, i) -> char_length({parts}[i]) + char_length(m))"))
    df = df.withColumn(starts, F.expr(running(steps)))
    placed = F.expr(
        f"""CAST(transform({found}, (m, i) -> named_struct(
            'start', CAST({starts}[i] AS INT) + char_length({parts}[i]), 'end', CAST({starts}[i] AS INT) + {steps}[i],
            'kind', {kind}, 'token', {values}[i])) AS {_SPAN})"""
    )
    return df.withColumn(name, placed).drop(found, parts, values, steps, starts)


def _encoding(token: str, of: int) -> str:
    """0: the encoding's number; 2: its alphabet, chosen by the token."""
    cases = " ".join(f"WHEN {token} RLIKE {_q(e[1])} THEN {i if of == 0 else _q(e[of])}" for i, e in enumerate(ENCODINGS))
    return f"(CASE {cases} END)"


#: Normal distribution function of a column expression ``z`` (Abramowitz and Stegun 26.2.17).
def _phi(z: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({z})))"
    tail = f"(exp(-0.5 * {z} * {z}) / sqrt(2 * pi()) * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {z} < 0 THEN {tail} ELSE 1 - {tail} END)"


def battery(df: DataFrame, spans: str) -> DataFrame:
    """Adds ``_tested``: the spans with encoding, the three statistics and p."""
    steps = [
        f"transform({spans}, c -> named_struct('start', c.start, 'end', c.end, 'token', c.token, 'n', CAST(char_length(c.token) AS DOUBLE), 'encoding', {_encoding('c.token', 0)}, 'alphabet', {_encoding('c.token', 2)}))",
        """transform(_tested, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'n', c.n, 'k', CAST(char_length(c.alphabet) AS DOUBLE),
            'squares', aggregate(filter(split(c.alphabet, ''), x -> x != ''), 0D, (a, x) -> a + pow(c.n - char_length(replace(c.token, x, '')), 2)),
            'walk', aggregate(transform(filter(split(c.token, ''), x -> x != ''), x -> CAST(instr(c.alphabet, x) AS DOUBLE)),
                named_struct('last', -1D, 'runs', 0D, 'high', 0D, 's', 0D, 'ss', 0D, 'sp', 0D, 'first', -1D),
                (a, x) -> named_struct('last', x,
                    'runs', a.runs + CASE WHEN a.last < 0 OR (a.last * 2 > char_length(c.alphabet)) != (x * 2 > char_length(c.alphabet)) THEN 1D ELSE 0D END,
                    'high', a.high + CASE WHEN x * 2 > char_length(c.alphabet) THEN 1D ELSE 0D END,
                    's', a.s + x, 'ss', a.ss + x * x, 'sp', a.sp + CASE WHEN a.last < 0 THEN 0D ELSE a.last * x END, 'first', CASE WHEN a.first < 0 THEN x ELSE a.first END))))""",
        f"""transform(_tested, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'n', c.n, 'k', c.k,
            'chi2', c.k / c.n * c.squares - c.n,
            'shift', c.n * greatest({LEAST_UNEVEN}D, {SAME_LETTER}D * c.k - 1),
            'runs_z', CASE WHEN c.walk.high > 0 AND c.walk.high < c.n THEN
                (c.walk.runs - 1 - 2 * c.walk.high * (c.n - c.walk.high) / c.n)
                / sqrt(greatest(1e-9D, 2 * c.walk.high * (c.n - c.walk.high) * (2 * c.walk.high * (c.n - c.walk.high) - c.n) / (c.n * c.n * (c.n - 1)))) ELSE 99D END,
            'serial_z', CASE WHEN c.n * c.walk.ss - c.walk.s * c.walk.s > 0 THEN
                (c.n * (c.walk.sp + c.walk.last * c.walk.first) - c.walk.s * c.walk.s) / (c.n * c.walk.ss - c.walk.s * c.walk.s) * sqrt(c.n) ELSE 99D END))""",
        f"""transform(_tested, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'n', c.n,
            'chi2', c.chi2, 'runs_z', c.runs_z, 'serial_z', c.serial_z,
            'z', greatest((c.chi2 - (c.k - 1) - c.shift) / sqrt(2 * (c.k - 1 + 2 * c.shift)),
                abs(c.runs_z) - {DEPENDENCE}D * sqrt(c.n), abs(c.serial_z) - {DEPENDENCE}D * sqrt(c.n))))""",
        f"transform(_tested, c -> named_struct('start', c.start, 'end', c.end, 'encoding', c.encoding, 'n', c.n, 'chi2', c.chi2, 'runs_z', c.runs_z, 'serial_z', c.serial_z, 'p', {_phi('c.z')}))",
    ]
    for step in steps:
        df = df.withColumn("_tested", F.expr(step))
    return df


def threshold(df: DataFrame, rate: float = RATE) -> float:
    """The largest weighted p-value that the step-up procedure over all rows' ``_tested`` takes; -1 if it takes none."""
    tests = df.select(F.explode("_tested").alias("c")).select((F.col("c.n") / MIDDLE).alias("w"), F.col("c.p").alias("p"))
    bin_of = F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(-F.log10(F.greatest(F.col("p") / F.col("w"), F.lit(1e-300))) * PER_DECADE)))
    rows = tests.groupBy(bin_of.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()
    return step_up({r["bin"]: r["n"] for r in rows}, sum(r["w"] for r in rows), rate)


def step_up(counts: dict[int, int], weight: float, rate: float) -> float:
    """``counts`` of the bins; bin b has the weighted p-values up to ``10 ** (-b / PER_DECADE)`` that the next one hasn't."""
    taken, best = 0, -1.0
    for b in range(BINS, -1, -1):
        taken += counts.get(b, 0)
        if taken and 10 ** (-b / PER_DECADE) * weight <= rate * taken:
            best = 10 ** (-b / PER_DECADE)
    return best


def discover(df: DataFrame, rate: float = RATE) -> DataFrame:
    """Adds ``random``: the spans of ``_tested`` that pass the weighted step-up procedure over the table."""
    cut = threshold(df, rate)
    spans = f"transform(filter(_tested, c -> c.p * {MIDDLE} / c.n <= {cut!r}D), c -> named_struct('start', c.start, 'end', c.end, 'kind', 3, 'token', CAST(NULL AS STRING)))"
    return df.withColumn("random", F.expr(f"CAST({spans} AS {_SPAN})")).drop("_tested")


def _scan(df: DataFrame) -> DataFrame:
    """Adds the arrays of spans to a DataFrame with the columns ``_row`` and ``text``, which isn't null."""
    out = _matches(df, "assign", ASSIGN, 0, value=2)
    out = out.withColumn("assign", F.expr(f"filter(assign, s -> char_length(s.token) >= {LEAST_VALUE})"))
    out = _matches(out, "access", ACCESS, 1)
    out = _matches(out, "hex", HEX, 2)
    out = _matches(out, "_candidate", CANDIDATE, 3)
    return discover(battery(out, "_candidate")).drop("_candidate")


def scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep``, ``text`` (null: empty), and ``assign``, ``access``, ``hex``, ``random``: arrays of spans (start, end, kind, token)."""
    results = ("text", "assign", "access", "hex", "random")
    kept = [c for c in keep if c not in results] or [F.lit(None).alias("_none")]
    found = _scan(df.select(F.struct(*kept).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    return found.select("_row.*", *results).drop("_none")


def _joined(*names: str) -> Column:
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    spans = f"concat({', '.join(names)})" if len(names) > 1 else names[0]
    return F.expr(f"array_join(transform(array_sort(transform({spans}, s -> struct(s.start, s.kind, s.end))), s -> concat(array({kinds})[s.kind], ':', s.start, ':', s.end)), ',')")


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows and columns of ``df`` with every secret in ``text`` (null: empty) replaced; spans that meet are replaced by one mark."""
    found = _scan(df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    spans = "array_sort(transform(concat(assign, access, hex, random), s -> struct(s.start AS start, s.end AS end)))"
    # the parts between spans: from the furthest end so far to the next start
    new = f"""CASE WHEN size(spans) = 0 THEN text ELSE aggregate(spans, named_struct('at', 0, 'out', ''),
        (a, s) -> CASE WHEN s.end <= a.at THEN a
            WHEN s.start < a.at THEN named_struct('at', s.end, 'out', a.out)
            ELSE named_struct('at', s.end, 'out', concat(a.out, substring(text, a.at + 1, s.start - a.at), '{mark}')) END,
        a -> concat(a.out, substring(text, a.at + 1))) END"""
    clean = found.select("_row", "text", F.expr(spans).alias("spans")).select("_row", F.expr(new).alias("clean"))
    return clean.select(F.col("_row").withField(f"`{text}`", F.col("clean")).alias("_row")).select("_row.*")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir), keep=("doc_id",))
    size = lambda c: F.size(c).cast("long")
    return found.select("doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"), F.sha2(_joined("assign", "access", "hex"), 256).alias("base_sha256"), _joined("assign", "access", "hex", "random").alias("spans"), size("random").alias("n_random"))
