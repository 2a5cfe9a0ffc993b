"""Line-first quality rules, in DataFrame expressions only.

Rules look at each line; lines that fail go, and a document that loses too much of its text goes too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import columns_of, fresh, let, quoted, with_text, words

SYMBOLS = "#*$%&|<>"
NAMES = ("clean_text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = " \t\n\x0b\f\r"
BOILERPLATE = r"cookie|privacy policy|terms of (use|service)|all rights reserved|javascript|lorem ipsum|click here|sign (in|up) |subscribe"
#: Production limits, in percent where not said otherwise.
LIMITS = {"symbols": 3, "upper": 40, "separators": 3, "boilerplate_chars": 200, "label_words": 3, "unpunctuated_words": 40, "lost": 50, "repeats": 20, "words": 10, "window": 5}


def count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def repeat_words(w: Column, window: int) -> Column:
    """Words that lie in a ``window``-word window found twice or more in the text.

    Windows are 64-bit hashes. Texts without an equal pair stop there; in others the hashes are sorted
    with their places, equal neighbours mark the places, and the union of the windows is summed up, so
    the work is n log n in the words of a text.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, j: F.coalesce(F.least(F.get(places, j + 1) - p, F.lit(window)), F.lit(window)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def marked(pairs: Column) -> Column:
        same = lambda p, q: F.coalesce(q["h"] == p["h"], F.lit(False))
        twice = F.filter(pairs, lambda p, j: (same(p, F.get(pairs, j + 1))) | ((j > 0) & same(p, F.get(pairs, F.greatest(j - 1, F.lit(0))))))
        return let(F.array_sort(F.transform(twice, lambda p: p["i"])), covered)

    def of_windows(k: Column) -> Column:
        pairs = F.array_sort(F.transform(k, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(k)) < F.size(k), let(pairs, marked)).otherwise(F.lit(0).cast("long"))

    def of_hashes(h: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window))))
        return F.when(F.size(h) >= window, let(windows, of_windows)).otherwise(F.lit(0).cast("long"))

    return let(F.transform(w, lambda x: F.xxhash64(x)), of_hashes)


def bad_line(line: Column, limits: dict) -> Column:
    """Whether a line (with a word in it) fails a rule."""
    chars, n = F.length(line), F.size(words(line))
    low = F.lower(line)
    end = F.rlike(line, F.lit(r"""[.!?…:;"'”’»)\]][\x20\x09-\x0D]*$"""))
    symbols = F.lit(100) * count_of(line, SYMBOLS) > limits["symbols"] * chars
    shouting = (F.lit(100) * count_of(line, UPPER) > limits["upper"] * chars) & (chars >= 20)
    navigation = (F.length(line) - F.length(F.translate(line, "|»›•·", ""))) >= limits["separators"]
    label = ~end & (n < limits["label_words"])
    flat = (n > limits["unpunctuated_words"]) & ~F.rlike(line, F.lit("[.!?…:;,。、]"))
    boilerplate = (chars <= limits["boilerplate_chars"]) & F.rlike(low, F.lit(BOILERPLATE))
    return symbols | shouting | navigation | label | flat | boilerplate


def judged(docs: DataFrame, limits: dict | None = None) -> tuple[DataFrame, str]:
    """All columns of docs and one struct with what :func:`quality_rules` adds, under a name that docs does not have; and that name."""
    lim = LIMITS | (limits or {})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # blank lines stay, so each is told from all others by its number behind a line end, which no line holds
    told = F.transform(F.split(text, "\n"), lambda s, i: F.when(F.rlike(s, F.lit(r"[^\x20\x09-\x0D]")), s).otherwise(F.concat(F.lit("\n"), i.cast("string"))))
    blank = lambda s: F.startswith(s, F.lit("\n"))

    def of_stay(stay: Column) -> Column:
        return F.struct(
            F.array_join(F.transform(stay, lambda s: F.when(blank(s), F.lit("")).otherwise(s)), "\n").alias("clean"),
            F.aggregate(stay, F.lit(0).cast("long"), lambda a, s: a + F.when(blank(s), F.lit(0)).otherwise(F.length(s))).alias("good"),
        )

    def line_counts(all_lines: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            stay = F.filter(F.array_distinct(all_lines), lambda s: blank(s) | ~bad_line(s, lim))
            return F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("dup"),
                F.aggregate(lines, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"),
                let(stay, of_stay).alias("stay"),
            )

        return let(F.filter(all_lines, lambda s: ~blank(s)), of_lines)

    w_, l_, c_, s_, v_ = (fresh(x, docs.columns) for x in ("words", "lines", "chars", "symbols", "verdict"))
    counted = let(words(text), lambda x: F.struct(F.size(x).cast("long").alias("n"), repeat_words(x, lim["window"]).alias("rep")))
    out = docs.select(*columns_of(docs), counted.alias(w_), let(told, line_counts).alias(l_), F.length(F.translate(text, BLANKS, "")).cast("long").alias(c_), count_of(text, SYMBOLS).cast("long").alias(s_))
    n, rep = F.col(w_)["n"], F.col(w_)["rep"]
    failed = (n < lim["words"]) | (F.lit(100) * rep > F.lit(lim["repeats"]) * n)
    stays = F.lit(100) * F.col(l_)["stay"]["good"] >= F.lit(100 - lim["lost"]) * F.col(l_)["chars"]
    values = (F.col(l_)["stay"]["clean"], n, F.col(c_), F.col(s_), F.col(l_)["dup"], rep, failed, ~failed & stays)
    return out.select(*columns_of(docs), F.struct(*(v.alias(k) for k, v in zip(NAMES, values, strict=True))).alias(v_)), v_


def quality_rules(docs: DataFrame, limits: dict | None = None) -> DataFrame:
    """All columns of docs, and: clean_text (the lines that stay), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    A null text has no words, so it fails; so does an empty one. A line's later copies go with the failed lines;
    blank lines stay, as empty ones. A column of docs with one of these names is replaced. Rows are judged one by
    one, so repeated rows stay repeated, very long texts cost n log n of their words, nothing is shuffled, and an
    empty table gives an empty result. Boilerplate is a rule for lines of at most ``boilerplate_chars`` characters:
    a longer line is prose that mentions such words.
    """
    out, v = judged(docs, limits)
    rest = [F.col(quoted(c)) for c in docs.columns if c.lower() not in NAMES]
    return out.select(*rest, *(F.col(v)[k].alias(k) for k in NAMES))


def keep_good(docs: DataFrame, limits: dict | None = None) -> DataFrame:
    """The documents that pass, without the lines that failed: text is the clean text, n_chars, where there is one, its length.

    All other columns come back as they were, whatever their names; odd input fares as in :func:`quality_rules`.
    """
    out, v = judged(docs, limits)
    # a filter would be pushed below and judge every text a second time; the row number, which counts for nothing, keeps it above
    here = fresh("kept", [*docs.columns, v])
    out = out.withColumn(here, F.col(v)["kept"] & (F.monotonically_increasing_id() >= 0)).filter(F.col(here))
    clean = F.col(v)["clean_text"]
    return out.select(*with_text(docs, clean))


def count_sql(s: str) -> str:
    return f"(length({s}) - length(translate({s}, '{SYMBOLS}', '')))"


def bad_line_sql() -> str:
    """DuckDB SQL for whether the line ``s`` fails a rule."""
    lim = LIMITS
    count = lambda s, chars: f"(length({s}) - length(translate({s}, '{chars}', '')))"
    ends = r"""regexp_matches(s, '[.!?…:;"''”’»)\]][\x20\x09-\x0D]*$')"""
    n_of = r"len(list_filter(regexp_split_to_array(s, '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
    return f"""(100 * {count_sql("s")} > {lim["symbols"]} * length(s)
        or (100 * {count("s", UPPER)} > {lim["upper"]} * length(s) and length(s) >= 20)
        or {count("s", "|»›•·")} >= {lim["separators"]}
        or (not {ends} and {n_of} < {lim["label_words"]})
        or ({n_of} > {lim["unpunctuated_words"]} and not regexp_matches(s, '[.!?…:;,。、]'))
        or (length(s) <= {lim["boilerplate_chars"]} and regexp_matches(lower(s), '{BOILERPLATE}')))"""


def oracle_sql() -> str:
    """DuckDB SQL for the query's columns."""
    lim, bad = LIMITS, bad_line_sql()
    has_word = r"regexp_matches(s, '[^\x20\x09-\x0D]')"
    return rf"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    w as (select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                 list_filter(string_split(t, chr(10)), lambda s: {has_word}) as l from d),
    g as (select doc_id, i, list_slice(w, i, i + {lim["window"] - 1}) as gram
          from (select doc_id, w, unnest(range(1, len(w) - {lim["window"] - 2})) as i from w)),
    twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as n from g) where n > 1),
    rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {lim["window"]})) as p from twice) group by doc_id),
    f as (select w.doc_id, len(w) as n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as word_chars,
                 {count_sql("t")} as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words,
                 coalesce(list_sum(list_transform(l, lambda s: length(s))), 0) as chars,
                 coalesce(list_sum(list_transform(list_distinct(list_filter(l, lambda s: not {bad})), lambda s: length(s))), 0) as good
          from w left join rep on rep.doc_id = w.doc_id),
    b as (select *, (n_words < {lim["words"]} or 100 * n_repeat_words > {lim["repeats"]} * n_words) as base_failed from f)
    select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
           cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
           (not base_failed and 100 * good >= {100 - lim["lost"]} * chars) as kept
    from b"""
