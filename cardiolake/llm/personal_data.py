r"""Operator 12 - personal data, DataFrame functions only.

Regular expressions propose spans, checksum validators confirm them and context words
adjust their score.  One proposal pattern a kind reads the whole text; its matches and
the gaps between them give the positions, so nothing is searched twice and no row leaves
its partition.  The base patterns are written so that they run in time linear in the
text: a look-behind (or the end of the previous match) fixes where a run may begin and
runs do not backtrack, which leaves the leftmost non-overlapping matches as they are.

Base spans (email, ip, card, phone) always stay.  The method adds, where the score of
proposal, validator and context reaches ``threshold``:

* ``card``: numbers of 13 to 19 digits, or in groups of four, inside a chain of digits
  that as a whole is no card (Luhn confirms; 13 to 15 digits need a context word);
* ``phone``: the longest 8 to 15 digits up to a space at the front of an international
  number whose match as a whole has too many digits; national numbers beside a context word;
* ``iban``: a country code with that country's length, confirmed by mod-97;
* ``ssn``: three, two and four digits of a valid area beside a context word.

Scores are whole hundredths (``SCORES``): proposal plus validator, plus ``CONTEXT`` if a
word of the kind's list stands in the ``REACH`` characters before or after (up to the
neighbouring proposal of the same pattern), minus it if only a word of ``AGAINST`` does.

Scale: one scan, no shuffle, no state beyond a row.  Positions are running sums in blocks
(``_running``), so a text with very many matches costs little more than its length.

Defined results: a null text counts as empty and has no spans; very long texts are read
whole; every row is judged alone, so repeated rows get equal results and a null doc_id is
allowed; spans of one kind never overlap but for added ones, spans of different kinds may,
and ties of start are ordered by end; an empty table gives no rows; columns of any
other name pass through ``find_pii`` and do not enter ``op12_personal_data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, in forms that do not backtrack.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
EMAIL = rf"(?={_LOCAL})(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++"
IP = r"(?=[0-9])(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CHAIN = r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Patterns of the added spans.
CARD_INSIDE = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])"
PHONE_FRONT = r"^(\+[0-9](?:[\x20().-]*[0-9]){7,14})\x20"
NATIONAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Lengths of account numbers by country code, as the public registry has them.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT",
    26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
IBAN = "(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")(?![A-Za-z0-9])"

# Words near a span that speak for a kind, and words that speak against all.
WORDS = {
    "card": "card cards credit debit visa mastercard amex karte kreditkarte carte tarjeta",
    "phone": "phone telephone tel call mobile cell fax telefon anruf handy mobil appel portable llamar telefono",
    "iban": "iban bank account konto compte cuenta",
    "ssn": "ssn social security",
}
AGAINST = "order invoice isbn issn version serial tracking sku part reference bestellung rechnung commande facture pedido factura"
#: Score of the proposal and of its validator.
SCORES = {"card": (30, 30), "short_card": (20, 30), "phone": (40, 20), "national": (35, 0), "iban": (30, 50), "ssn": (30, 10), "email": (60, 20), "ip": (40, 20)}
CONTEXT, REACH, THRESHOLD = 25, 48, 60
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of all earlier elements; in blocks, as appending copies what is there."""

    def short(xs: Column, first: Column) -> Column:
        start = F.struct(first.cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("out"))
        return F.aggregate(xs, start, lambda a, x: F.struct((a.at + x).alias("at"), F.concat(a.out, F.array(a.at)).alias("out")), lambda a: a.out)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _BLOCK)), lambda k: F.slice(lengths, (k * _BLOCK + 1).cast("int"), F.lit(_BLOCK)))
    firsts = short(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0))
    return F.flatten(F.zip_with(blocks, firsts, short))


def _near(before: Column, after: Column, kind: str) -> Column:
    has = lambda words: F.lower(F.concat(before, F.lit(" . "), after)).rlike(rf"(?:^|[^a-z])(?:{words.replace(' ', '|')})(?:[^a-z]|$)")
    return F.when(has(WORDS[kind]), CONTEXT).when(has(AGAINST), -CONTEXT).otherwise(0) if kind in WORDS else F.lit(0)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check.  Every second digit from the right counts
    twice, with its digits added; the digits' characters are split once, not looked up one by one."""
    single, twice = "0123456789", "0246813579"
    total = lambda marks: F.aggregate(F.filter(F.split(marks, ""), lambda c: c != ""), F.lit(0), lambda a, c: a + c.cast("int"))
    even = F.concat(F.repeat(F.lit("0"), F.length(digits) % 2), digits)  # an even count, so doubled digits stand first in each pair
    return (total(F.translate(F.regexp_replace(even, "(.)(.)", "$1"), single, twice)) + total(F.regexp_replace(even, "(.)(.)", "$2"))) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number without spaces has remainder 1 (letters count from 10)."""
    turned = F.concat(F.substr(number, F.lit(5), F.length(number)), F.substr(number, F.lit(1), F.lit(4)))
    step = lambda a, c: F.when(F.ascii(c) >= 65, (a * 100 + F.ascii(c) - 55) % 97).otherwise((a * 10 + F.ascii(c) - 48) % 97)
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


_NONE = "cast(array() as array<struct<start:bigint,end:bigint,match:string,before:string,after:string>>)"


def _proposals(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """A column a name: struct(start, end, match, before, after) of every match, by start."""
    df = df.withColumns({f"{n}_m": F.regexp_extract_all(text, F.lit(p), F.lit(0)) if c is None else F.when(c, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for n, (p, c) in patterns.items()})
    df = df.withColumns({f"{n}_g": F.when(F.size(f"{n}_m") > 0, F.split(text, p, -1)) for n, (p, _) in patterns.items()})
    steps = lambda n: F.zip_with(F.slice(f"{n}_g", 1, F.size(f"{n}_m")), f"{n}_m", lambda g, m: (F.length(g) + F.length(m)).cast("long"))
    df = df.withColumns({f"{n}_l": F.when(F.size(f"{n}_m") > 0, steps(n)) for n in patterns})
    df = df.withColumns({f"{n}_s": F.when(F.size(f"{n}_m") > 0, _running(F.col(f"{n}_l"))) for n in patterns})

    def spans(n: str) -> Column:
        def one(start: Column, i: Column) -> Column:
            gap, match = F.get(f"{n}_g", i), F.get(f"{n}_m", i)
            at = start + F.length(gap)
            return F.struct(at.alias("start"), (at + F.length(match)).alias("end"), match.alias("match"), F.right(gap, F.lit(REACH)).alias("before"), F.left(F.get(f"{n}_g", i + 1), F.lit(REACH)).alias("after"))

        return F.coalesce(F.transform(f"{n}_s", one), F.expr(_NONE))

    return df.withColumns({n: spans(n) for n in patterns}).drop(*[f"{n}_{x}" for n in patterns for x in "mgls"])


def _found(kind: str, span: Column, score: Column, base: bool, start: Column | None = None, match: Column | None = None) -> Column:
    start, match = span.start if start is None else start, span.match if match is None else match
    return F.struct(start.alias("start"), (start + F.length(match)).alias("end"), F.lit(kind).alias("kind"), match.alias("match"), score.cast("int").alias("score"), F.lit(base).alias("base"))


def _scored(kind: str, name: str, span: Column) -> Column:
    return F.lit(sum(SCORES[name])) + _near(span.before, span.after, kind)


def _base_card(s: Column) -> Column:
    """The proposal with its verdict ``ok``."""
    verdict = F.transform(F.array(F.translate(s.match, " -", "")), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(False))
    return F.struct(*[s[c].alias(c) for c in ("start", "end", "match", "before", "after")], F.get(verdict, F.lit(0)).alias("ok"))


def _base_phone(s: Column) -> Column:
    return F.length(_digits(s.match)).between(8, 15)


def _inside(df: DataFrame, chains: str) -> DataFrame:
    """Columns of the chains that are no card: ``pii_failed``, and per chain its matches of
    ``CARD_INSIDE`` (``pii_in_m``), the gaps before them and their starts, as in ``_proposals``."""
    df = df.withColumn("pii_failed", F.filter(chains, lambda s: ~s.ok))
    df = df.withColumns({"pii_in_m": F.transform("pii_failed", lambda c: F.regexp_extract_all(c.match, F.lit(CARD_INSIDE), F.lit(0))), "pii_in_g": F.transform("pii_failed", lambda c: F.split(c.match, CARD_INSIDE, -1))})
    df = df.withColumn("pii_in_l", F.transform("pii_in_m", lambda ms, k: F.zip_with(F.slice(F.get("pii_in_g", k), F.lit(1), F.size(ms)), ms, lambda g, m: (F.length(g) + F.length(m)).cast("long"))))
    return df.withColumn("pii_in_s", F.transform("pii_in_l", lambda n: F.when(F.size(n) > 0, _running(n))))


def _cards_inside(threshold: int) -> Column:
    """Added cards of the chains of ``_inside``."""

    def one(chain: Column, k: Column, match: Column, i: Column) -> Column:
        start = chain.start + F.get(F.get("pii_in_s", k), i) + F.length(F.get(F.get("pii_in_g", k), i))
        d = F.translate(match, " -", "")
        score = F.when(F.length(d) < 16, _scored("card", "short_card", chain)).otherwise(_scored("card", "card", chain))
        return _found("card", chain, F.when(luhn(d), score).otherwise(0), False, start, match)

    found = F.flatten(F.transform("pii_failed", lambda chain, k: F.transform(F.get("pii_in_m", k), lambda match, i: one(chain, k, match, i))))
    return F.filter(found, lambda f: f.score >= threshold)


def find_pii(docs: DataFrame, threshold: int = THRESHOLD, text: str = "text", out: str = "findings") -> DataFrame:
    """``docs`` with one more column ``out``: array of (start, end, kind, match, score, base),
    by kind in the order of ``KINDS``, then by start.  Positions are code points, ``end`` exclusive."""
    hold = "pii_row"
    df = docs.select(F.struct("*").alias(hold), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("pii_text"))
    t, digits = "pii_text", F.col("pii_digits")
    df = df.withColumn("pii_digits", F.col(t).rlike("[0-9][0-9 .-]{2}"))
    df = _proposals(
        df,
        t,
        {
            "pii_email": (EMAIL, F.contains(F.col(t), F.lit("@"))),
            "pii_ip": (IP, digits),
            "pii_chain": (CHAIN, digits),
            "pii_phone": (PHONE, F.contains(F.col(t), F.lit("+"))),
            "pii_national": (NATIONAL, digits),
            "pii_iban": (IBAN, digits),
            "pii_ssn": (SSN, digits),
        },
    )
    df = _inside(df.withColumn("pii_chain", F.transform("pii_chain", _base_card)), "pii_chain")
    enough = lambda f: f.score >= threshold
    by_kind = {
        "email": [F.transform("pii_email", lambda s: _found("email", s, F.lit(sum(SCORES["email"])), True))],
        "ip": [F.transform(F.filter("pii_ip", lambda s: s.match.rlike(BYTE)), lambda s: _found("ip", s, F.lit(sum(SCORES["ip"])), True))],
        "card": [
            F.transform(F.filter("pii_chain", lambda s: s.ok), lambda s: _found("card", s, _scored("card", "card", s), True)),
            _cards_inside(threshold),
        ],
        "phone": [
            F.transform(F.filter("pii_phone", _base_phone), lambda s: _found("phone", s, _scored("phone", "phone", s), True)),
            F.filter(
                F.transform(F.filter("pii_phone", lambda s: ~_base_phone(s) & s.match.rlike(PHONE_FRONT)), lambda s: _found("phone", s, _scored("phone", "phone", s), False, match=F.regexp_extract(s.match, PHONE_FRONT, 1))), enough
            ),
            F.filter(F.transform(F.filter("pii_national", lambda s: ~s.before.rlike(r"\+[0-9]{1,3}[\x20.-]?$")), lambda s: _found("phone", s, _scored("phone", "national", s), False)), enough),
        ],
        "iban": [F.filter(F.transform(F.filter("pii_iban", lambda s: mod97(F.translate(s.match, " ", ""))), lambda s: _found("iban", s, _scored("iban", "iban", s), False)), enough)],
        "ssn": [F.filter(F.transform(F.filter("pii_ssn", lambda s: ~s.match.rlike(r"^(?:000|666|9)|-00-|0000$")), lambda s: _found("ssn", s, _scored("ssn", "ssn", s), False)), enough)],
    }
    found = F.concat(*[F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0] for parts in (by_kind[k] for k in KINDS)])
    return df.withColumn("pii_found", found).select(*[F.col(f"{hold}.`{c}`").alias(c) for c in docs.columns if c != out], F.col("pii_found").alias(out))


def _joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    df = find_pii(docs).drop("text").withColumn("base", F.filter("findings", lambda s: s.base))
    count = lambda spans, kind: F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
    return df.select(
        "doc_id",
        *[count("base", k).alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("findings")).alias("spans"),
        (F.size("findings") - F.size("base")).cast("long").alias("n_added"),
    )


# ---------------------------------------------------------------- the same in SQL


def _sql_words(kind: str) -> str:
    has = lambda words: f"regexp_matches(lower(before || ' . ' || after), '(?:^|[^a-z])(?:{words.replace(' ', '|')})(?:[^a-z]|$)')"
    return f"CASE WHEN {has(WORDS[kind])} THEN {CONTEXT} WHEN {has(AGAINST)} THEN -{CONTEXT} ELSE 0 END"


def _sql_spans(name: str, pattern: str, keep: str = "true", source: str = "docs", text: str = "text") -> str:
    """Rows (doc_id, s, e, m, before, after) of the matches that ``keep``: positions by a running
    sum over matches and gaps, contexts cut from the text up to the neighbouring match."""
    own = "doc_id" if source == "docs" else "doc_id, s0"
    return f"""{name}_l AS (SELECT *, regexp_extract_all({text}, '{pattern}') AS ms, string_split_regex({text}, '{pattern}') AS gs FROM {source}),
{name}_u AS (SELECT * EXCLUDE (ms, gs), unnest(ms) AS m, generate_subscripts(ms, 1) AS i, unnest(gs[1:len(ms)]) AS g FROM {name}_l WHERE len(ms) > 0),
{name}_p AS (SELECT * EXCLUDE (i, g), CAST(sum(length(g) + length(m)) OVER w - length(m) AS BIGINT) AS s, CAST(sum(length(g) + length(m)) OVER w AS BIGINT) AS e FROM {name}_u WINDOW w AS (PARTITION BY {own} ORDER BY i ROWS UNBOUNDED PRECEDING)),
{name}_c AS (SELECT *, greatest(s - {REACH}, coalesce(lag(e) OVER v, 0)) AS c0, coalesce(lead(s) OVER v, length({text})) AS c1 FROM {name}_p WHERE {keep} WINDOW v AS (PARTITION BY {own} ORDER BY s)),
{name} AS (SELECT *, substr({text}, c0 + 1, s - c0) AS before, substr({text}, e + 1, least({REACH}, c1 - e)) AS after FROM {name}_c)"""


_LUHN = "(SELECT sum(CASE WHEN k % 2 = 0 THEN (2 * v) % 10 + (2 * v) // 10 ELSE v END) FROM (SELECT k, CAST(substr({d}, length({d}) - k + 1, 1) AS INT) AS v FROM range(1, 20) r(k) WHERE k <= length({d}))) % 10 = 0"
_MOD97 = "list_reduce([CAST(ascii(c) - CASE WHEN c >= 'A' THEN 55 ELSE 48 END AS BIGINT) FOR c IN string_split(substr({d}, 5) || substr({d}, 1, 4), '')], lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97, 0::BIGINT) = 1"
_PLAIN_IBAN = "(?:" + "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items()) + ")"
_s = lambda name: sum(SCORES[name])

OP12_SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_sql_spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")},
{_sql_spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")},
{_sql_spans("chain", r"[0-9](?:[ -]?[0-9])+", "length(replace(replace(m, ' ', ''), '-', '')) >= 13")},
{_sql_spans("phone", r"\+[0-9][ ().0-9-]+[0-9]")},
{_sql_spans("iban", _PLAIN_IBAN, "NOT regexp_matches(substr(text, s, 1), '[A-Za-z0-9]') AND NOT regexp_matches(substr(text, e + 1, 1), '[A-Za-z0-9]')")},
{_sql_spans("ssn", r"[0-9-]*[0-9]{3}-[0-9]{2}-[0-9]{4}[0-9-]*", "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}')")},
{_sql_spans("national", r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}", "NOT regexp_matches(substr(text, s, 1), '[0-9+(.-]') AND NOT regexp_matches(substr(text, e + 1, 1), '[0-9-]')")},
card AS (SELECT *, CASE WHEN length(d) BETWEEN 16 AND 19 THEN {_LUHN.format(d="d")} ELSE false END AS ok FROM (SELECT *, replace(replace(m, ' ', ''), '-', '') AS d FROM chain)),
failed AS (SELECT doc_id, s AS s0, before AS b0, after AS a0, m AS chain_text FROM card WHERE NOT ok),
{_sql_spans("inside", "[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]+", "true", "failed", "chain_text")},
dialled AS (SELECT *, length(regexp_replace(m, '[^0-9]', '', 'g')) AS n, regexp_extract(m, '^(\\+[0-9](?:[ ().-]*[0-9]){{7,14}}) ', 1) AS front FROM phone),
spans AS (
  SELECT doc_id, 'email' AS kind, s, e, true AS base FROM email
  UNION ALL SELECT doc_id, 'ip', s, e, true FROM ip WHERE list_bool_and([length(ltrim(p, '0')) < 4 AND CAST('0' || ltrim(p, '0') AS HUGEINT) <= 255 FOR p IN string_split(m, '.')])
  UNION ALL SELECT doc_id, 'card', s, e, true FROM card WHERE ok
  UNION ALL SELECT doc_id, 'card', s0 + s, s0 + e, false FROM (SELECT * EXCLUDE (before, after), b0 AS before, a0 AS after, replace(replace(m, ' ', ''), '-', '') AS d FROM inside) WHERE length(d) BETWEEN 13 AND 19
    AND {_LUHN.format(d="d")} AND CASE WHEN length(d) < 16 THEN {_s("short_card")} ELSE {_s("card")} END + {_sql_words("card")} >= {THRESHOLD}
  UNION ALL SELECT doc_id, 'phone', s, e, true FROM dialled WHERE n BETWEEN 8 AND 15
  UNION ALL SELECT doc_id, 'phone', s, s + length(front), false FROM dialled WHERE NOT n BETWEEN 8 AND 15 AND front <> '' AND {_s("phone")} + {_sql_words("phone")} >= {THRESHOLD}
  UNION ALL SELECT doc_id, 'phone', s, e, false FROM national WHERE NOT regexp_matches(before, '\\+[0-9]{{1,3}}[ .-]?$') AND {_s("national")} + {_sql_words("phone")} >= {THRESHOLD}
  UNION ALL SELECT doc_id, 'iban', s, e, false FROM (SELECT *, replace(m, ' ', '') AS d FROM iban)
    WHERE {_MOD97.format(d="d")} AND {_s("iban")} + {_sql_words("iban")} >= {THRESHOLD}
  UNION ALL SELECT doc_id, 'ssn', s, e, false FROM ssn WHERE NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$') AND {_s("ssn")} + {_sql_words("ssn")} >= {THRESHOLD}
),
lists AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position({list(KINDS)}, kind), s, e) AS spans,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY list_position({list(KINDS)}, kind), s, e) FILTER (base) AS base_spans,
    count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip, count(*) FILTER (base AND kind = 'card') AS n_card, count(*) FILTER (base AND kind = 'phone') AS n_phone, count(*) FILTER (NOT base) AS n_added
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(l.spans, '') AS spans, coalesce(n_added, 0) AS n_added
FROM docs d LEFT JOIN lists l USING (doc_id)
"""
