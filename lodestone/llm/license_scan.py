"""Licence scans: the Dice coefficient of word bigrams, repeats counted, between licence templates and texts.

Compared are every line of a text, the whole text, and windows of lines: from the start of a line as many words as the
template has, so that a licence wrapped over lines anywhere in a longer text is found. A window starts at a line of which
as many words are words of templates as the bound below asks for. Normalised: ASCII letters in lower case and digits; the
rest, comment marks included, is blanks. With coefficient t at least, a unit of a bigrams can only match a template of b
bigrams where t / (2 - t) <= a / b <= (2 - t) / t, and t / (2 - t) of its own bigrams must be bigrams of templates; of a
window, t (a + b) / 2 + 1 words must be words of templates, which is counted by lines first. The bounds follow from the
coefficient and lose nothing; what they leave is compared exactly. Only SQL functions, no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.license_texts import TEMPLATES
from lodestone.operators.tensors import let

SIMILARITY = 0.8


def words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), text)).split()


def bigrams(text: str) -> list[str]:
    """Numbered where they repeat: "a b#0", "a b#1"."""
    w, seen, out = words(text), Counter(), []
    for a, b in zip(w, w[1:], strict=False):
        out.append(f"{a} {b}#{seen[a, b]}")
        seen[a, b] += 1
    return out


def _numbered(grams: Column) -> Column:
    in_order = F.array_sort(grams)
    return F.transform(in_order, lambda g, i: F.concat(g, F.lit("#"), (i + 1 - F.array_position(in_order, g)).cast("string")))


def _pairs(words: Column) -> Column:
    n = F.size(words)
    return F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.concat(a, F.lit(" "), b))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, similarity: float = SIMILARITY) -> DataFrame:
    """A row per unit that matches: id, line (from 1; 0: the whole text of several lines), last_line, license, dice (10 places).

    Of several templates the one with the largest coefficient counts for a line or the whole text, ties by name. Of the
    windows over several lines, each licence's best one of a text counts, ties by the first line. Null, empty and wordless
    texts match nothing; null ids stay; repeated rows give repeated rows; other columns are left aside; long texts are
    split into lines where they are, in one row's memory.
    """
    grams = {name: bigrams(text) for name, text in templates.items()}
    grams = {name: g for name, g in grams.items() if g}
    share = similarity / (2 - similarity)
    low, high = min(ceil(share * len(g) - 1e-9) for g in grams.values()), max(int(len(g) / share + 1e-9) for g in grams.values())
    longest = max(map(len, grams.values()))
    known = sorted({g.rpartition("#")[0] for own in grams.values() for g in own})
    table = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("b"), F.array(*map(F.lit, g)).alias("grams")) for name, g in sorted(grams.items())))

    vocabulary = sorted({w for g in known for w in g.split(" ")})

    # one expression for a row's lines: split apart, Spark would push parts of it below filters and evaluate them again
    lines = F.transform(F.split(F.col(text_col).cast("string"), "\n"), lambda x: F.array_remove(F.split(x, "[^A-Za-z0-9]+"), ""))
    # as many of its words must be words of templates
    own = lambda ws: F.size(F.filter(ws, lambda w: F.lower(w).isin(vocabulary)))
    total = lambda ws: F.aggregate(ws, F.lit(0), lambda n, w: n + F.size(w))
    none = (F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("minus"))
    unit = lambda line, last, w: F.struct(line.cast("int").alias("line"), last.cast("int").alias("last"), w.alias("words"), *none)

    def units(ws: Column) -> Column:
        whole = F.when((F.size(ws) > 1) & (total(ws) <= high + 1), F.array(unit(F.lit(0), F.size(ws), F.flatten(ws)))).otherwise(F.array())
        found = F.concat(F.transform(ws, lambda w, i: unit(i + 1, i + 1, w)), whole)
        return F.filter(found, lambda u: F.size(u["words"]).between(low + 1, high + 1) & (own(u["words"]) >= (F.size(u["words"]) - 1) * share - 1e-9))

    def windows(ws: Column, info: Column) -> Column:
        """info: of each line its number of words, and of words of templates."""
        starts = F.filter(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: info[i - 1]["n"].between(1, longest) & (info[i - 1]["k"] >= info[i - 1]["n"] * share - 1e-9))

        def enough(i: Column, b: Column) -> Column:
            sums = F.aggregate(F.slice(info, i, b + 1), F.struct(F.lit(0).alias("n"), F.lit(0).alias("k")), lambda acc, x: F.when(acc["n"] > b, acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), (acc["k"] + x["k"]).alias("k"))))
            a = lambda s: F.least(s["n"] - 1, b)
            return let(sums, lambda s: (info[i - 1]["n"] <= a(s)) & (a(s) >= b * share - 1e-9) & (s["k"] >= (a(s) + b) * similarity / 2 + 1 - 1e-9))

        def scored(i: Column, t: Column) -> Column:
            words = F.transform(F.slice(F.flatten(F.slice(ws, i, t["b"] + 1)), F.lit(1), t["b"] + 1), lambda w: F.lower(w))

            def row(w: Column) -> Column:
                upto = F.aggregate(F.slice(info, i, t["b"] + 1), F.struct(F.lit(0).alias("n"), F.lit(0).alias("lines")), lambda acc, x: F.when(acc["n"] >= F.size(w), acc).otherwise(F.struct((acc["n"] + x["n"]).alias("n"), (acc["lines"] + 1).alias("lines"))))
                both = F.size(w) - 1 + t["b"]
                # enough of its bigrams must be bigrams of templates, before they are numbered
                exact = lambda g: F.when(F.size(F.filter(g, lambda x: x.isin(known))) >= both * similarity / 2 - 1e-9, -2.0 * F.size(F.array_intersect(_numbered(g), t["grams"])) / both).otherwise(0.0)
                minus = let(_pairs(w), exact)
                return F.struct(t["license"].alias("license"), minus.alias("minus"), i.cast("int").alias("line"), (i + upto["lines"] - 1).cast("int").alias("last"))

            return let(words, row)

        found = F.flatten(F.transform(starts, lambda i: F.transform(F.filter(table, lambda t: enough(i, t["b"])), lambda t: scored(i, t))))
        found = F.array_sort(F.filter(found, lambda x: x["minus"] <= -similarity + 1e-12))
        best = let(found, lambda xs: F.filter(xs, lambda x, k: (k == 0) | (F.get(xs, F.greatest(k - 1, F.lit(0)))["license"] != x["license"])))
        return F.transform(best, lambda x: F.struct(x["line"].alias("line"), x["last"].alias("last"), F.array().cast("array<string>").alias("words"), x["license"].alias("license"), x["minus"].alias("minus")))

    def all_of(ws: Column) -> Column:
        info = F.transform(ws, lambda w: F.struct(F.size(w).alias("n"), own(w).alias("k")))
        return F.when(F.size(ws) > 1, F.concat(units(ws), let(info, lambda i: windows(ws, i)))).otherwise(units(ws))

    rows = docs.select(F.col(id_col).alias("_id"), F.explode_outer(let(lines, all_of)).alias("_unit")).filter(F.col("_unit").isNotNull())
    rows = rows.select("_id", F.col("_unit.line").alias("line"), F.col("_unit.last").alias("last_line"), F.col("_unit.license").alias("_license"), F.col("_unit.minus").alias("_minus"), F.transform("_unit.words", lambda w: F.lower(w)).alias("_words"))
    done = F.col("_license").isNotNull()
    rows = rows.select("_id", "line", "last_line", "_license", "_minus", F.when(done, F.array().cast("array<string>")).otherwise(_pairs(F.col("_words"))).alias("_grams"), (F.size("_words") - 1).alias("_a"))
    rows = rows.filter(done | (F.size(F.filter("_grams", lambda g: g.isin(known))) >= F.col("_a") * share - 1e-9))
    close = F.filter(table, lambda t: F.col("_a").between(t["b"] * share - 1e-9, t["b"] / share + 1e-9))
    rows = rows.select("_id", "line", "last_line", "_license", "_minus", "_a", _numbered(F.col("_grams")).alias("_grams"), close.alias("_close"))
    scores = F.transform("_close", lambda t: F.struct((-2.0 * F.size(F.array_intersect("_grams", t["grams"])) / (F.col("_a") + t["b"])).alias("minus"), t["license"].alias("license")))
    best = F.when(done, F.struct(F.col("_minus").alias("minus"), F.col("_license").alias("license"))).otherwise(F.array_min(scores))
    rows = rows.select("_id", "line", "last_line", best.alias("_best")).filter(F.col("_best.minus") <= -similarity + 1e-12)
    return rows.select(F.col("_id").alias(id_col), "line", "last_line", F.col("_best.license").alias("license"), F.round(-F.col("_best.minus"), 10).alias("dice"))


def oracle() -> str:
    """The same in DuckDB, by joining numbered bigrams; windows are cut for every line that may start one and every template."""
    grams = {n: bigrams(t) for n, t in TEMPLATES.items()}
    values = ", ".join(f"('{name}', {len(g)}, '{x}')" for name, g in grams.items() for x in g)
    vocabulary = ", ".join(f"'{w}'" for w in sorted({w for t in TEMPLATES.values() for w in words(t)}))
    share = SIMILARITY / (2 - SIMILARITY)
    return f"""
        WITH t(license, b, gram) AS (VALUES {values}),
             sizes AS (SELECT DISTINCT license, b FROM t),
             p AS (SELECT doc_id, string_split(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL),
             d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_transform(l, lambda x: list_filter(string_split(x, ' '), lambda y: y <> '')) AS l FROM p),
             i AS (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
             u AS (SELECT r, doc_id, i AS line, i AS last_line, NULL AS license, l[i] AS w FROM i
                   UNION ALL SELECT r, doc_id, 0, len(l), NULL, flatten(l) FROM d WHERE len(l) > 1),
             s AS (SELECT r, doc_id, l, i, license, b, flatten(l[i : i + b])[1 : b + 1] AS w FROM i, sizes
                   WHERE i < len(l) AND len(l[i]) > 0 AND len(list_filter(l[i], lambda x: x IN ({vocabulary}))) >= {share}::DOUBLE * len(l[i]) - 1e-9),
             v AS (SELECT r, doc_id, i AS line, list_position(list_transform(range(i, len(l) + 1), lambda j: list_sum(list_transform(l[i : j], lambda x: len(x))) >= len(w)), true) + i - 1 AS last_line, license, w FROM s
                   WHERE len(w) > len(l[i]) AND len(w) - 1 >= {share}::DOUBLE * b - 1e-9 AND len(list_filter(w, lambda x: x IN ({vocabulary}))) >= {SIMILARITY}::DOUBLE * (len(w) - 1 + b) / 2 + 1 - 1e-9),
             k AS (SELECT row_number() OVER () AS k, * FROM (SELECT * FROM u WHERE len(w) BETWEEN 2 AND 600 UNION ALL SELECT * FROM v)),
             g AS (SELECT k, doc_id, line, last_line, license AS wanted, len(w) - 1 AS a, w[i] || ' ' || w[i + 1] AS g, r FROM (SELECT *, unnest(range(1, len(w))) AS i FROM k)),
             n AS (SELECT k, r, doc_id, line, last_line, wanted, a, g || '#' || (row_number() OVER (PARTITION BY k, g) - 1) AS gram FROM g),
             c AS (SELECT k, any_value(r) AS r, any_value(doc_id) AS doc_id, any_value(line) AS line, any_value(last_line) AS last_line, any_value(wanted) AS wanted, license, 2.0 * count(*) / (any_value(a) + any_value(b)) AS dice
                   FROM n JOIN t ON n.gram = t.gram AND (wanted IS NULL OR wanted = license) GROUP BY k, license),
             o AS (SELECT *, CASE WHEN wanted IS NULL THEN row_number() OVER (PARTITION BY k ORDER BY dice DESC, license)
                                  ELSE row_number() OVER (PARTITION BY r, wanted ORDER BY dice DESC, line) END AS place FROM c WHERE dice >= {SIMILARITY}::DOUBLE - 1e-12)
        SELECT doc_id, line::INTEGER AS line, last_line::INTEGER AS last_line, license, round(dice::DOUBLE, 10) AS dice FROM o WHERE place = 1
    """
