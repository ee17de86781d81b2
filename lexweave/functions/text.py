"""Text functions over page sources and replies; built-in expressions throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases of entries that only point to another form, markers of page categories, and words left out of definitions.
FORM_PHRASES = ("past tense of", "past participle of", "present participle of", "plural of", "singular of", "comparative of", "superlative of", "third person singular of", "third-person singular of", "feminine of", "masculine of", "alternative spelling of", "archaic spelling of", "misspelling of", "singular form of", "plural form of", "past form of", "form of")
NUMBER_MARKERS = ('title="number"', 'title="ordinal number"', 'title="cardinal number"')
PROPER_MARKERS = ("toc-proper_noun", "toc-proper noun", "/wiki/category:proper_nouns", 'id="proper_noun"', "category:proper nouns")
ALLOWED_MARKERS = ("toc-verb", "toc-adjective", "toc-noun", "category:nouns", "category:verbs", "category:adjectives")
LEFT_OUT = ("be", "to", "if")
END_MARKERS = ("<dl", "<ul")
END_WORDS = ("synonyms:", "antonyms:")


def _any(text: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def cut_at_markers(html: Column) -> Column:
    """html up to the first end marker."""
    far = F.length(html) + 1
    places = [F.when(F.instr(html, m) > 0, F.instr(html, m)).otherwise(far) for m in END_MARKERS] + [F.when(F.instr(F.lower(html), m) > 0, F.instr(F.lower(html), m)).otherwise(far) for m in END_WORDS]
    return F.substring(html, F.lit(1), F.least(*places) - 1)


def html_definition(html: Column) -> Column:
    """The definition span's text, else the page description after " is " and before a usage note; null if there is neither."""
    span = F.regexp_extract(html, r'(?s)<span class="dtText">(.*?)</span>', 1)
    has_span = html.rlike(r'(?s)<span class="dtText">.*?</span>')
    plain = F.regexp_replace(F.replace(F.replace(F.regexp_replace(span, "<[^>]+>", ""), F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"(?U)^\s+|\s+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(?U)^:\s*", ""), r"(?U)\s+$", "")
    has_meta = html.rlike('<meta name="description" content="[^"]*"')
    meta = F.regexp_extract(html, '<meta name="description" content="([^"]*)"', 1)
    meta = F.regexp_replace(meta, r"(?s)^.*? is ", "")
    return F.when(has_span, plain).when(has_meta, F.substring_index(meta, ". How to use", 1))


def without_parentheses(text: Column) -> Column:
    return F.regexp_replace(text, r"\([^)]*\)", "")


def definition_tokens(text: Column) -> Column:
    """Words of a definition: punctuation but periods gone, outer periods stripped, one-letter words and those with digits out."""
    clean = F.regexp_replace(text, r"(?U)[^\w\s.]", "")
    words = F.transform(F.split(clean, r"(?U)\s+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.filter(words, lambda t: (F.length(t) > 1) & ~t.rlike(r"(?U)\d"))


def validated_tokens(text: Column) -> Column:
    """Words with outer punctuation stripped, of two letters or more and nothing but letters."""
    words = F.transform(F.split(text, r"(?U)\s+"), lambda t: F.regexp_replace(t, r"(?U)^[^\w\s]+|[^\w\s]+$", ""))
    return F.filter(words, lambda t: t.rlike(r"^\p{L}{2,}\z"))


def unique_tokens(tokens: Column, word: Column) -> Column:
    """Lowered, in order, without repeats, the word itself and the words left out."""
    lowered = F.transform(tokens, lambda t: F.lower(t))
    return F.filter(F.array_distinct(lowered), lambda t: ~t.isin(*LEFT_OUT) & (t != F.lower(word)))


def is_form_redirect(text: Column) -> Column:
    return _any(F.lower(text), FORM_PHRASES)


def is_allowed_category(html: Column) -> Column:
    """False for numbers and proper nouns, then true for noun, verb and adjective pages."""
    low = F.lower(html)
    return F.when(_any(low, NUMBER_MARKERS) | _any(low, PROPER_MARKERS), False).otherwise(_any(low, ALLOWED_MARKERS))


def entry_reason(entry: Column, html: Column, definition: Column) -> Column:
    """Why an entry is kept or not."""
    return F.when(~entry.rlike(r"^[a-z]+$"), "invalid_format").when(~is_allowed_category(html), "not_allowed_category").when(F.coalesce(definition, F.lit("")) == "", "empty_definition").when(F.lower(definition).rlike(r"\bsuffix\b"), "is_suffix").otherwise("success")


def page_links(pages: DataFrame) -> DataFrame:
    """(target, label): distinct links of list items."""
    items = F.regexp_extract_all("html", F.lit(r'<li><a href="[^"]*">[^<]*</a></li>'), F.lit(0))
    link = F.explode(items)
    rows = pages.select(link.alias("item"))
    return rows.select(F.regexp_extract("item", r'href="([^"]*)"', 1).alias("target"), F.regexp_extract("item", r">([^<]*)</a>", 1).alias("label")).distinct()


def without_math(html: Column) -> Column:
    """html with formula images replaced by their texts, and formula markup gone."""
    plain = F.regexp_replace(html, r'(?s)<span[^>]*class="[^"]*mwe-math-mathml-inline[^"]*"[^>]*>.*?</span>', "")
    image = r'<img(?=[^>]*class="[^"]*mwe-math-fallback-image-inline[^"]*")(?:(?!alt=)[^>])*alt="{alt}"[^>]*>'
    inner = F.regexp_replace(plain, image.replace("{alt}", r"\{\\displaystyle ([^\"]*)\}"), "$1")
    return F.regexp_replace(inner, image.replace("{alt}", r'([^"]*)'), "$1")


def final_form(word: Column, html: Column) -> Column:
    """The word that an entry points to: the first italic text without a question mark of its first definition, else the word itself."""
    listed = F.regexp_extract(html, r"(?s)<ol[^>]*>(.*?)(?:</ol>|\z)", 1)
    first = F.when(listed.rlike("<li"), F.regexp_extract(listed, r"(?s)<li[^>]*>(.*?)(?:</li>|\z)", 1)).otherwise(listed)
    main = without_parentheses(cut_at_markers(first))
    texts = F.transform(F.regexp_extract_all(main, F.lit(r"(?s)<i(?:\s[^>]*)?>(.*?)</i>"), F.lit(1)), lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", "")))
    return F.coalesce(F.try_element_at(F.filter(texts, lambda x: ~F.contains(x, F.lit("?"))), F.lit(1)), word)


def quoted(word: Column) -> Column:
    """Percent-encoded UTF-8 of all but letters, digits and _ . - ~."""
    out = F.url_encode(word)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def joined_url(base: Column, link: Column) -> Column:
    """A link made absolute: itself with a scheme, else under the base's scheme, host or folder."""
    scheme, host = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder == host, F.concat(host, F.lit("/"))).otherwise(folder)
    out = F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link))
    return out.when(link.startswith("/"), F.concat(host, link)).when(link == "", base).otherwise(F.concat(folder, link))


def next_page(url: Column, html: Column) -> Column:
    """The address behind "Next page" of an index page; null on the last one."""
    nav = F.regexp_extract(html, r'(?s)<div[^>]*class="[^"]*mw-allpages-nav[^"]*"[^>]*>(.*?)</div>', 1)
    link = F.regexp_extract(nav, r'<a[^>]*href="([^"]*)"[^>]*>Next page', 1)
    return F.when(link != "", joined_url(url, F.replace(link, F.lit("&amp;"), F.lit("&"))))


def json_definitions(reply: Column) -> Column:
    """The items of the JSON array within a reply, those with word and definition; null if it cannot be read."""
    found = F.from_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0), "array<struct<word:string,definition:string>>")
    return F.filter(found, lambda x: x["word"].isNotNull() & x["definition"].isNotNull())


def length_assignment(words: DataFrame, shares: list[tuple[int, int]], fallback: int = 4, seed: int = 42) -> DataFrame:
    """(word, length): words (word) in hashed order are dealt to lengths by their shares; halves round to even, the rest get the fallback."""
    n = words.count()
    total, bounds, at = sum(s for _, s in shares), [], 0
    for length, share in shares:
        take = min(round(n * share / total), n - at)
        bounds.append((at, at + take, length))
        at += take
    order = Window.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "word").cast("binary")), "word")
    ranked = words.withColumn("k", F.row_number().over(order) - 1)
    length = reduce(lambda acc, b: acc.when((F.col("k") >= b[0]) & (F.col("k") < b[1]), b[2]), bounds[1:], F.when((F.col("k") >= bounds[0][0]) & (F.col("k") < bounds[0][1]), bounds[0][2])).otherwise(fallback)
    return ranked.select("word", length.alias("length"))


def length_plan(assigned: DataFrame, batch: int = 100) -> DataFrame:
    """Words, batches and output tokens for each length."""
    per = assigned.groupBy("length").agg(F.count("*").alias("n_words"))
    return per.select("length", "n_words", F.ceil(F.col("n_words") / batch).alias("n_batches"), (F.col("n_words") * (F.col("length") + 15)).cast("long").alias("output_tokens"))


def batches(assigned: DataFrame, batch: int = 100) -> DataFrame:
    """(length, batch, n, request): JSON arrays of at most `batch` words, in order."""
    k = F.row_number().over(Window.partitionBy("length").orderBy("word")) - 1
    rows = assigned.withColumn("batch", F.floor(k / batch))
    return rows.groupBy("length", "batch").agg(F.count("*").alias("n"), F.to_json(F.array_sort(F.collect_list("word"))).alias("request"))


def system_prompt(length: Column) -> Column:
    """The instruction to define words with an exact number of nouns, adjectives and base verbs, as a JSON array."""
    return F.format_string("Define each word with exactly %d words, only nouns, adjectives and verbs in base form, separated by blanks. Reply with one JSON array of objects with word and definition and nothing else.", length)
