"""Personal data by candidate gradient boosting, in DataFrame operations only.

Base spans come from four patterns with their checks (email; ip with parts to 255; card with 13 to 19 digits passing Luhn;
phone with + and 9 to 15 digits), leftmost and not overlapping per kind. High-recall generators propose further spans on the
text with the base spans of their kind blanked out: mail addresses with spelled-out signs, dotted quads and colon groups,
13 to 19 digits in any usual grouping (also inside longer runs of digits, where the base pattern swallows them), phone
numbers with or without country code, and long tokens (kind secret, which has no base pattern). Spans of different kinds
may overlap.

Every match, of a base pattern or a generator, is described by format, check and context features of few values each, so the
distinct feature patterns are at most MAX_PATTERNS whatever the corpus. The check is what the match itself shows: a known
top-level domain; parts to 255 or a whole colon form; Luhn for every length; a number of digits that a phone has, with a country
code or brackets; a known issuer's prefix or a variety of characters that looks random. A match gets a weak label where its check or
the words before it speak: a phone word for a number, a word for secrets or an issuer's prefix for a token, and words (version, invoice)
against it; one that neither speaks about is not labelled. Labelled patterns are counted over all documents and added to a prior of
PRIOR_MATCHES matches for each case that the checks decide, gradient-boosted trees are fitted to the counts and compiled to a SQL
expression, and per kind the threshold is the lowest score at which the lower confidence bound of precision reaches PRECISION: the
prior alone gives one on a small table, and a table's own counts move it. Generated spans above it are added.

Positions need no Python: the pattern's matches are put between markers and the text is split there; the pieces before and
after a match are its context, and running sums of the pieces' lengths (in blocks of BLOCK, then over the blocks) give code
points. Overlaps need no comparison, as base spans are blanked out. So the work per document is in proportion to its text and
its matches (the sum over blocks costs matches ** 2 / 8192 array moves, which is nothing below millions of matches).
Patterns start only where a run starts and never backtrack into it, so long runs of one character class stay linear too.

Edge cases: null and empty texts have no spans; the control characters 1 to 4 are read as 0 (no pattern has any of them);
rows are independent, so repeated rows get equal results; an empty table gives an empty result and no added spans; other
columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
PRECISION, ROUNDS, SHRINK = 0.9, 24, 0.4
BLOCK, NEAR = 64, 32
JOIN, DOT, MARK, MASK = "\x01", "\x02", "\x03", "\x04"

#: Each runs on the text column named with it: text, or the one with separators marked.
BASE = {
    "email": ("t_mail", rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]*+"),
    "ip": ("t", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": ("t_card", rf"(?<![0-9{JOIN}])[0-9][0-9{JOIN}]++"),
    "phone": ("t", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: On the text with the base spans of the kind blanked out; of cards, single spaces and hyphens between digits are JOIN.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[({](?:at|AT)[\])}] ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]{1,63}+){1,6}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}|[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+)(?![0-9A-Za-z:])",
    "card": rf"(?<![0-9])(?:[0-9]{{4}}{JOIN}?[0-9]{{4}}{JOIN}?[0-9]{{4}}{JOIN}?[0-9]{{4}}|3[0-9]{{3}}{JOIN}?[0-9]{{6}}{JOIN}?[0-9]{{4,5}}|[0-9]{{13,19}})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+",
}
#: Context words, by kind, and words that speak against all kinds.
CONTEXT = {"email": "mail|contact|write to", "ip": r"\bip\b|host|server|addr", "card": r"card|visa|credit|\bcc\b", "phone": r"phone|tel\b|call|fax|mobile", "secret": "never"}
AGAINST = r"version|isbn|invoice|order|serial"
SECRET_WORDS = r"token|secret|passw|pwd|api.?key|access.?key|private|bearer|auth|credential"
#: Top-level domains that speak for a mail address.
DOMAINS = (
    "com org net edu gov mil int info biz name io dev app ai co me tv us uk ca au nz ie de at ch fr be nl lu es pt it gr pl cz sk hu ro bg se no dk fi is ee lv lt "
    "ru ua by tr il in cn jp kr tw hk sg my th vn id ph br ar mx cl pe za eg ma ng ke ae sa eu"
).replace(" ", "|")

#: Feature names and numbers of values.
FEATURES = (("kind", 5), ("form", 4), ("shape", 4), ("seps", 4), ("left", 4), ("right", 4), ("context", 3), ("spread", 2), ("check", 3))
MAX_PATTERNS = math.prod(n for _, n in FEATURES)
#: What is known before a table is read, as so many labelled matches each: (kind, context, check, hits in a hundred). So a small table
#: has thresholds too, and a document gets the same spans in any table unless the table's own counts speak clearly against it.
PRIOR_MATCHES = 100
PRIOR = (
    ("email", 0, 1, 100), ("email", 0, 0, 5), ("ip", 0, 1, 100), ("ip", 0, 0, 0), ("ip", 2, 1, 5), ("card", 0, 1, 100), ("card", 1, 1, 100), ("card", 0, 0, 0), ("card", 1, 0, 0), ("card", 2, 1, 5),
    ("phone", 0, 2, 100), ("phone", 1, 2, 100), ("phone", 1, 1, 100), ("phone", 0, 1, 50), ("phone", 0, 0, 0), ("phone", 2, 1, 0), ("phone", 2, 2, 0),
    ("secret", 0, 2, 100), ("secret", 0, 1, 50), ("secret", 0, 0, 0),
)
#: How tokens of well-known issuers begin.
PREFIXES = (
    "(sk|pk|rk)[_-]|gh[opsur]_|github_pat_|glpat-|xox[abeoprs]-|(AKIA|ASIA)[0-9A-Z]{16}$|AIza|ya29[._-]|eyJ[A-Za-z0-9]|npm_|pypi-|hf_|shp(at|ca|pa|ss)_|dop_v1_|lin_api_|SG[._-]|AC[0-9a-f]{32}$|EAA[A-Za-z0-9]"
)
#: A token of so many different characters looks random.
VARIED = 12


def _hidden(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN int(substr({d}, -i, 1))"
    " ELSE int((2 * int(substr({d}, -i, 1))) div 10) + (2 * int(substr({d}, -i, 1))) % 10 END) % 10 = 0"
)
PART = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
QUAD = f"x.m rlike '^{PART}[.]{PART}[.]{PART}[.]{PART}$'"
CARD = f"length({DIGITS}) BETWEEN 13 AND 19 AND {LUHN.format(d=DIGITS)}"
VALID = {"email": "true", "ip": QUAD, "card": CARD, "phone": f"length({DIGITS}) BETWEEN 9 AND 15"}

_NEAR = "lower(x.near)"
_SPEAKS_AGAINST = f"{_NEAR} rlike {_hidden(AGAINST)}"
#: Weak labels of a match x: 1, 0, or NULL.
LABEL = {
    "email": f"int(lower(x.m) rlike '[.\x02 )}}\\\\]]({DOMAINS})$')",
    "ip": f"int(({QUAD} OR x.m rlike '^([0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$' OR (x.m rlike '::' AND x.m rlike '[A-Fa-f0-9]{{2}}')) AND NOT {_SPEAKS_AGAINST})",
    "card": f"int({CARD} AND NOT {_SPEAKS_AGAINST})",
    "phone": (
        f"CASE WHEN {_SPEAKS_AGAINST} OR length({DIGITS}) NOT BETWEEN 9 AND 15 THEN 0"
        f" WHEN x.m rlike '^[+]|[(]' OR {_NEAR} rlike {_hidden(CONTEXT['phone'])} THEN 1 END"
    ),
    "secret": f"int({_NEAR} rlike {_hidden(SECRET_WORDS)} OR x.m rlike {_hidden(f'^({PREFIXES})')})",
}
#: What the match itself shows: 0 speaks against it.
CHECK = {
    "email": f"int(lower(x.m) rlike '[.\x02 )}}\\\\]]({DOMAINS})$')",
    "ip": f"int(({QUAD} OR x.m rlike '^([0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}$' OR (x.m rlike '::' AND x.m rlike '[A-Fa-f0-9]{{2}}')))",
    "card": f"int({CARD})",
    "phone": f"CASE WHEN length({DIGITS}) NOT BETWEEN 9 AND 15 THEN 0 WHEN x.m rlike '^[+]|[(]' THEN 2 ELSE 1 END",
    "secret": f"CASE WHEN x.m rlike {_hidden(f'^({PREFIXES})')} THEN 2 ELSE int(size(array_distinct(split(x.m, ''))) >= {VARIED}) END",
}
_N_DIGITS = f"length({DIGITS})"
FORM = {
    "email": "CASE WHEN x.m NOT rlike '[\\\\[({]' THEN 0 WHEN x.m rlike '(?i)dot' AND x.m rlike '(?i)at[\\\\])}]' THEN 1 WHEN x.m rlike '(?i)at[\\\\])}]' THEN 2 ELSE 3 END",
    "ip": "CASE WHEN x.m NOT rlike ':' THEN 0 WHEN x.m rlike '::' THEN 1 WHEN length(regexp_replace(x.m, '[^:]', '')) = 7 THEN 2 ELSE 3 END",
    "card": "CASE WHEN x.m rlike '^4' THEN 0 WHEN x.m rlike '^[25]' THEN 1 WHEN x.m rlike '^[36]' THEN 2 ELSE 3 END",
    "phone": "CASE WHEN x.m rlike '^[+]' THEN int(x.m rlike '[(]') ELSE 2 + int(x.m rlike '[(]') END",
    "secret": "CASE WHEN x.m rlike '^([0-9a-f]+|[0-9A-F]+)$' THEN 0 WHEN x.m rlike '[+/=]' THEN 1 WHEN x.m rlike '[_-]' THEN 2 ELSE 3 END",
}
SHAPE = {
    "email": "CASE WHEN x.m rlike '[0-9]$' THEN 3 WHEN x.m rlike '[^A-Za-z][A-Za-z]{2}$' THEN 0 WHEN x.m rlike '[^A-Za-z][A-Za-z]{3}$' THEN 1 ELSE 2 END",
    "ip": f"CASE WHEN {_N_DIGITS} <= 6 THEN 0 WHEN {_N_DIGITS} <= 9 THEN 1 WHEN {_N_DIGITS} <= 12 THEN 2 ELSE 3 END",
    "card": f"CASE {_N_DIGITS} WHEN 16 THEN 0 WHEN 15 THEN 1 WHEN 13 THEN 2 WHEN 14 THEN 2 ELSE 3 END",
    "phone": f"CASE {_N_DIGITS} WHEN 10 THEN 0 WHEN 11 THEN 1 WHEN 12 THEN 2 WHEN 13 THEN 2 ELSE 3 END",
    "secret": "CASE length(x.m) WHEN 32 THEN 0 WHEN 40 THEN 1 WHEN 64 THEN 2 ELSE 3 END",
}


def _described(kind: str) -> str:
    """SQL of struct y (label), f (features) of a match x of the kind."""
    before, shown = "right(x.near, 1)", "regexp_replace(x.m, '[^0-9A-Za-z]', '')"
    side = lambda c: f"CASE WHEN {c} = '' OR {c} rlike '[\\\\s\\\\x01]' THEN 0 WHEN {c} rlike '[\\\\p{{L}}0-9]' THEN 1 WHEN {c} rlike '[.,;:!?]' THEN 2 ELSE 3 END"
    return (
        f"named_struct('y', {LABEL[kind]}, 'f', named_struct('kind', {ALL_KINDS.index(kind)}, 'form', {FORM[kind]}, 'shape', {SHAPE[kind]},"
        f" 'seps', least(size(array_distinct(split(regexp_replace(x.m, '[0-9A-Za-z]', ''), ''))), 4) - 1, 'left', {side(before)}, 'right', {side('x.after')},"
        f" 'context', CASE WHEN {_SPEAKS_AGAINST} THEN 2 WHEN {_NEAR} rlike {_hidden(CONTEXT[kind])} THEN 1 ELSE 0 END,"
        f" 'spread', int(size(array_distinct(split({shown}, ''))) > 3), 'check', {CHECK[kind]}))"
    )


def _pieces(df: DataFrame, sources: dict[str, tuple[str, str]]) -> DataFrame:
    """For each name and (text column, pattern): p_name, the text cut at the ends of the matches (NULL without one)."""
    cut = {n: F.split(F.regexp_replace(c, p, f"{MARK}$0{MARK}"), MARK) for n, (c, p) in sources.items()}
    return df.select("*", *[F.when(F.col(c).rlike(p), cut[n]).alias(f"p_{n}") for n, (c, p) in sources.items()])


def _matches(df: DataFrame, names: list[str]) -> DataFrame:
    """For each p_name: name, array<struct<s, e, m, near, after>> of its matches, in time linear in the pieces."""
    cols = df.columns
    df = df.select(*cols, *[F.expr(f"transform(p_{n}, x -> char_length(x))").alias(f"l_{n}") for n in names])
    inner = (
        f"transform(sequence(0, int((size(l_{{0}}) - 1) div {BLOCK})), b ->"
        f" aggregate(slice(l_{{0}}, b * {BLOCK} + 1, {BLOCK}), array(0), (a, x) -> array_append(a, element_at(a, -1) + x)))"
    )
    df = df.select(*cols, *[F.col(f"l_{n}") for n in names], *[F.expr(f"CASE WHEN l_{n} IS NOT NULL THEN {inner.format(n)} END").alias(f"b_{n}") for n in names])
    tops = "aggregate(b_{0}, array(0), (a, w) -> array_append(a, element_at(a, -1) + element_at(w, -1)))"
    df = df.select(*cols, *[F.col(f"{x}_{n}") for n in names for x in "lb"], *[F.expr(tops.format(n)).alias(f"u_{n}") for n in names])
    # u is named twice, as an expression named once is put into the lambda and computed for each of its elements
    begins = "CASE WHEN size(u_{0}) > 0 THEN flatten(transform(b_{0}, (w, k) -> transform(slice(w, 1, size(w) - 1), v -> v + u_{0}[k]))) END"
    df = df.select(*cols, *[F.col(f"l_{n}") for n in names], *[F.expr(begins.format(n)).alias(f"o_{n}") for n in names])
    one = (
        f"named_struct('s', o_{{0}}[2 * i - 1], 'e', o_{{0}}[2 * i - 1] + l_{{0}}[2 * i - 1], 'm', p_{{0}}[2 * i - 1],"
        f" 'near', right(p_{{0}}[2 * i - 2], {NEAR}), 'after', left(p_{{0}}[2 * i], 1))"
    )
    rows = "CASE WHEN size(p_{0}) > 1 THEN transform(sequence(1, int(size(p_{0}) div 2)), i -> " + one + ") END"
    return df.select(*cols, *[F.expr(rows.format(n)).alias(n) for n in names])


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind number, s, e), seen (labels and features of base matches), found (s, e, label, features)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    odd = F.contains(text, F.lit(JOIN)) | F.contains(text, F.lit(DOT)) | F.contains(text, F.lit(MARK)) | F.contains(text, F.lit(MASK))
    df = docs.select(F.col("doc_id").cast("bigint"), F.when(odd, F.regexp_replace(text, "[\x01-\x04]", "\x00")).otherwise(text).alias("t"))
    mail = F.when(F.contains("t", F.lit("@")), F.regexp_replace("t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)).otherwise("")
    card = F.when(F.col("t").rlike("[0-9]{2}|[0-9][ -][0-9]"), F.regexp_replace("t", "(?<=[0-9])[ -](?=[0-9])", JOIN)).otherwise("")
    df = _pieces(df.select("doc_id", "t", mail.alias("t_mail"), card.alias("t_card")), BASE)
    df = _matches(df, list(KINDS))
    checked = "transform({0}, x -> struct(x.s AS s, x.e AS e, {1} AS ok, {2} AS d))"
    df = df.select("doc_id", "t", "t_mail", "t_card", *[f"p_{k}" for k in KINDS], *[F.expr(checked.format(k, VALID[k], _described(k))).alias(k) for k in KINDS])
    blank = f"CASE WHEN exists({{0}}, x -> x.ok) THEN array_join(transform(p_{{0}}, (x, i) -> CASE WHEN i % 2 = 1 AND {{0}}[int((i - 1) div 2)].ok THEN repeat('{MASK}', char_length(x)) ELSE x END), '') ELSE {{1}} END"
    left = {k: F.expr(blank.format(k, BASE[k][0])) for k in KINDS}
    left["email"] = F.when(F.col("email").isNull(), F.col("t")).otherwise(F.translate(left["email"], DOT, "."))
    df = df.select("doc_id", "t", *KINDS, *[left[k].alias(f"m_{k}") for k in KINDS])
    df = _matches(_pieces(df, {f"g_{k}": (f"m_{k}" if k in KINDS else "t", p) for k, p in GENERATORS.items()}), [f"g_{k}" for k in ALL_KINDS])
    mixed = "filter(g_secret, x -> x.m rlike '[0-9]' AND x.m rlike '[A-Za-z]')"
    of = lambda k: mixed if k == "secret" else f"g_{k}"
    none = lambda e: f"coalesce({e}, array())"
    base = [none(f"transform(filter({k}, x -> x.ok), x -> named_struct('k', {i}, 's', x.s, 'e', x.e))") for i, k in enumerate(KINDS)]
    seen = [none(f"transform({k}, x -> x.d)") for k in KINDS]
    found = [none(f"transform({of(k)}, x -> struct(x.s AS s, x.e AS e, {_described(k)} AS d))") for k in ALL_KINDS]
    return df.select("doc_id", *[F.expr(f"concat({', '.join(x)})").alias(n) for n, x in (("base", base), ("seen", seen), ("found", found))])


class Boosted:
    """Trees of two levels over tests feature = value, fitted to weighted patterns by Newton steps on logistic loss."""

    def __init__(self, rows: list[tuple[tuple[int, ...], int, int]]):
        """rows: (pattern, count, hits)."""
        total, hits = sum(r[1] for r in rows), sum(r[2] for r in rows)
        self.bias = math.log((hits + 1) / (total - hits + 1))
        self.trees: list[tuple] = []
        margin = [self.bias] * len(rows)
        tests = sorted({(j, v) for r, _, _ in rows for j, v in enumerate(r)})
        for _ in range(ROUNDS if rows else 0):
            p = [1 / (1 + math.exp(-m)) for m in margin]
            g = [h - n * q for (_, n, h), q in zip(rows, p, strict=True)]
            w = [n * q * (1 - q) for (_, n, _), q in zip(rows, p, strict=True)]

            def gain(idx):
                a, b = sum(g[i] for i in idx), sum(w[i] for i in idx)
                return a * a / (b + 1)

            def leaf(idx):
                return SHRINK * sum(g[i] for i in idx) / (sum(w[i] for i in idx) + 1)

            def split(idx):
                best = (0.0, None)
                for j, v in tests:
                    yes = [i for i in idx if rows[i][0][j] == v]
                    if 0 < len(yes) < len(idx):
                        no = [i for i in idx if rows[i][0][j] != v]
                        best = max(best, (gain(yes) + gain(no) - gain(idx), (j, v)), key=lambda x: x[0])
                return best[1]

            def grow(idx, depth):
                test = split(idx) if depth else None
                if test is None:
                    return leaf(idx)
                yes, no = [i for i in idx if rows[i][0][test[0]] == test[1]], [i for i in idx if rows[i][0][test[0]] != test[1]]
                return (test, grow(yes, depth - 1), grow(no, depth - 1))

            tree = grow(list(range(len(rows))), 2)
            self.trees.append(tree)
            margin = [m + self._at(tree, r[0]) for m, r in zip(margin, rows, strict=True)]
        self.thresholds = [self._threshold([(m, n, h) for m, (r, n, h) in zip(margin, rows, strict=True) if r[0] == k]) for k in range(len(ALL_KINDS))]

    def _at(self, tree, pattern):
        while isinstance(tree, tuple):
            (j, v), yes, no = tree
            tree = yes if pattern[j] == v else no
        return tree

    @staticmethod
    def _threshold(rows: list[tuple[float, int, int]]) -> float:
        """The lowest margin above which the lower confidence bound of precision reaches PRECISION."""
        best, n, h = math.inf, 0, 0
        for margin in sorted({round(m, 9) for m, _, _ in rows}, reverse=True):
            n, h = n + sum(c for m, c, _ in rows if round(m, 9) == margin), h + sum(k for m, _, k in rows if round(m, 9) == margin)
            q, z = h / n, 1.645
            low = (q + z * z / (2 * n) - z * math.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)
            if low >= PRECISION:
                best = margin
        return best

    def sql(self) -> str:
        """Margin of candidate x."""

        def show(tree):
            if not isinstance(tree, tuple):
                return repr(float(tree)) + "D"
            (j, v), yes, no = tree
            return f"CASE WHEN x.d.f.{FEATURES[j][0]} = {v} THEN {show(yes)} ELSE {show(no)} END"

        return " + ".join([repr(float(self.bias)) + "D", *map(show, self.trees)])

    def chosen(self) -> str:
        limit = " ".join(f"WHEN {k} THEN {t - 1e-6!r}D" for k, t in enumerate(self.thresholds) if t < math.inf)
        return f"coalesce({self.sql()} >= CASE x.d.f.kind {limit} END, false)" if limit else "false"


def fit(found: DataFrame) -> Boosted:
    """Count the labelled patterns of all matches (at most MAX_PATTERNS rows) and fit the trees."""
    x = found.select(F.explode(F.expr("concat(seen, transform(found, x -> x.d))")).alias("x")).where("x.y IS NOT NULL")
    counts = x.groupBy("x.f").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x.y").cast("bigint")).alias("hits"))
    known = {tuple(r["f"]): (r["n"], r["hits"]) for r in counts.collect()}
    for kind, context, check, hits in PRIOR:
        pattern = (ALL_KINDS.index(kind), 0, 0, 0, 0, 0, context, 1, check)
        n, h = known.get(pattern, (0, 0))
        known[pattern] = (n + PRIOR_MATCHES, h + hits * PRIOR_MATCHES // 100)
    return Boosted(sorted((p, n, h) for p, (n, h) in known.items()))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and all spans: arrays of struct<kind, start, end>, by kind (in order of ALL_KINDS), then start."""
    found = stored(candidates(docs), "pii-candidates")
    model = fit(found)
    names = ", ".join(_hidden(k) for k in ALL_KINDS)
    named = "transform({0}, x -> named_struct('kind', element_at(array(" + names + "), x.k + 1), 'start', x.s, 'end', x.e))"
    added = f"transform(filter(found, x -> {model.chosen()}), x -> named_struct('k', x.d.f.kind, 's', x.s, 'e', x.e))"
    out = found.select("doc_id", "base", F.expr(added).alias("added"))
    return out.select("doc_id", F.expr(named.format("base")).alias("base"), F.expr(named.format("array_sort(concat(base, added))")).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op10: counts and digest of the base spans, and all spans."""
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = "array_join(transform({0}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    return out.select(
        "doc_id", *[F.expr(f"bigint(size(filter(base, x -> x.kind = '{k}')))").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.expr(joined.format("base")), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )
