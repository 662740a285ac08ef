"""Scalar functions on names, words, paths and URLs as column expressions. Null in, null out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

SPACE = r"(?U)\s+"


def normalize(text: Column) -> Column:
    """Trimmed, lower case, runs of any white space as one space."""
    return F.trim(F.regexp_replace(F.lower(text), SPACE, " "))


def compact(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, SPACE, "")


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(text, SPACE), lambda t: t != "")


def split_camel(text: Column) -> Column:
    """Lower-case words; a new one starts at signs and at a capital that a small letter follows."""
    apart = F.regexp_replace(text, r"(?<=[\p{L}\p{N}])(?=\p{Lu}\p{Ll})", " ")
    return F.transform(F.filter(F.split(apart, r"[^\p{L}\p{N}]+"), lambda t: t != ""), F.lower)


def acronym(words: Column) -> Column:
    """First characters of at least two words, else empty."""
    return F.when(F.size(words) >= 2, F.array_join(F.transform(words, lambda t: F.left(t, F.lit(1))), "")).otherwise("")


def grams(text: Column, n: int) -> Column:
    """All runs of n characters, in order; none in shorter texts."""
    last = F.length(text) - F.lit(n - 1)
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def _deletes(term: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(term), F.lit(1))), lambda i: F.concat(F.substr(term, F.lit(1), i - 1), F.substr(term, i + 1)))


def delete_variants(term: Column) -> Column:
    """What is left of a term of 2 to 18 characters after one deletion, of one up to 10 also after two.

    The term itself and the empty string are left out.
    """
    once = _deletes(term)
    both = F.when(F.length(term) <= 10, F.concat(once, F.flatten(F.transform(once, _deletes)))).otherwise(once)
    usable = F.filter(F.array_distinct(both), lambda v: (v != term) & (v != ""))
    return F.when(F.length(term).between(2, 18), usable).otherwise(F.array().cast("array<string>"))


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance with swaps of neighbours, no substring edited twice (optimal string alignment).

    A fold over the characters of ``a`` carries the last two rows of the table; within a row a fold
    over ``b`` appends cells.
    """
    n = F.length(b)
    first = F.sequence(F.lit(0), n)
    start = F.struct(F.array().cast("array<int>").alias("above"), first.alias("row"))

    def next_row(state: Column, i: Column) -> Column:
        above, row = state["above"], state["row"]

        def cell(out: Column, j: Column) -> Column:
            x, y = F.substr(a, i, F.lit(1)), F.substr(b, j, F.lit(1))
            swapped = (i > 1) & (j > 1) & (x == F.substr(b, F.greatest(j - 1, F.lit(1)), F.lit(1))) & (F.substr(a, F.greatest(i - 1, F.lit(1)), F.lit(1)) == y)
            # of the least, what is null does not count
            return F.array_append(out, F.least(F.element_at(out, -1) + 1, F.get(row, j) + 1, F.get(row, j - 1) + (x != y).cast("int"), F.when(swapped, F.get(above, j - 2) + 1)))

        steps = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.struct(row.alias("above"), F.aggregate(steps, F.array(i), cell).alias("row"))

    rows = F.when(F.length(a) > 0, F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.element_at(F.aggregate(rows, start, next_row)["row"], -1)


def fuzzy_budget(query: Column) -> Column:
    """Edits that a query allows, by its length in bytes."""
    n = F.octet_length(query)
    return F.when(n <= 2, 0).when(n <= 5, 1).otherwise(2)


def swapped(a: Column, b: Column) -> Column:
    """Whether ``b`` is ``a`` with one pair of neighbours swapped."""
    with_swap = lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2))
    return (F.length(a) == F.length(b)) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: with_swap(i) == b)


def fuzzy_score(query: Column, word: Column) -> Column:
    """400 for one edit, 280 for two within the budget, else null; lengths decide first.

    A swap of neighbours is two edits of the plain distance, so that one tells what most words are: 1
    is one edit, 2 is two or a swap, over 4 is too far. Only 3 and 4 need the table of swaps.
    """
    budget = fuzzy_budget(query)
    close = F.abs(F.length(query) - F.length(word)) <= budget
    plain = F.array(F.when(close, F.levenshtein(query, word, 4)).otherwise(-1))  # worked out once; -1 is over 4
    lost = F.length(F.call_function("translate", query, word, F.lit("")))  # characters of the query that the word lacks
    swaps = (budget == 2) & (lost <= 2) & (osa_distance(query, word) == 2)
    return F.get(F.transform(plain, lambda n: F.when((n == 1) & (budget >= 1), 400).when(n == 2, F.when((budget >= 1) & swapped(query, word), 400).when(budget == 2, 280)).when((n > 2) & swaps, 280)), 0)


CJK, CJK_WEB = "\\u3400-\\u4dbf\\u4e00-\\u9fff", "\\u3400-\\u4dbf\\u4e00-\\u9fff\\uf900-\\ufaff\\u3000-\\u303f"


def contains_cjk(text: Column, web: bool = False) -> Column:
    """Whether a text holds a Chinese character; on the web also compatibility forms and punctuation."""
    return F.rlike(text, F.lit(f"[{CJK_WEB if web else CJK}]"))


def script_parts(text: Column) -> Column:
    """Runs of CJK characters and of ASCII letters and digits, in order."""
    return F.regexp_extract_all(text, F.lit(f"([{CJK}]+|[A-Za-z0-9]+)"), F.lit(1))


def hash_id(*parts: Column) -> Column:
    """32 hex digits of SHA-256 over the parts, each closed by a zero byte."""
    joined = F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.char(F.lit(0)))))
    return F.substring(F.sha2(joined, 256), 1, 32)


def percent_encode(text: Column) -> Column:
    """All but letters, digits and ``-_.~`` as %XX of UTF-8."""
    steps = (("+", "%20"), ("*", "%2A"), ("%7E", "~"))
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, F.url_encode(text))


#: Where a search goes without a template: Chinese texts, all others (fixed values).
CHINESE_ENGINE, OTHER_ENGINE = "https://www.baidu.com/s?wd=", "https://www.bing.com/search?q="


def search_url(template: Column, query: Column) -> Column:
    """The query put in place of ``{searchTerms}`` or ``%s``, else behind the template; without a
    template the engine goes by the query's script."""
    q = percent_encode(query)
    put = F.when(F.contains(template, F.lit("{searchTerms}")), F.replace(template, F.lit("{searchTerms}"), q)).when(F.contains(template, F.lit("%s")), F.replace(template, F.lit("%s"), q)).otherwise(F.concat(template, q))
    return F.when(template.isNull() | (F.trim(template) == ""), F.concat(F.when(contains_cjk(query, True), CHINESE_ENGINE).otherwise(OTHER_ENGINE), q)).otherwise(put)


def valid_template(template: Column) -> Column:
    """Whether a search template is a web address that has a place for the query or takes it at its end."""
    t = F.trim(template)
    return F.coalesce(F.rlike(t, F.lit(r"^(?i)https?://[^\s/]+(/\S*)?$")) & (F.contains(t, F.lit("{searchTerms}")) | F.contains(t, F.lit("%s")) | F.rlike(t, F.lit(r"[=/]$"))), F.lit(False))


def normalize_url(text: Column) -> Column:
    """A URL for input that looks like one: a scheme stays, a bare host gets https; else null."""
    t = F.trim(text)
    host = r"(?i)^(www\.)?[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,24}(:[0-9]+)?([/?#].*)?$"
    file = r"(?i)\.(exe|lnk|txt|pdf|zip|doc|docx|png|jpg|md|dll|bat|cmd)$"
    return F.when(F.rlike(t, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://\S+$")), t).when(F.rlike(t, F.lit(host)) & ~F.rlike(t, F.lit(file)), F.concat(F.lit("https://"), t))


def path_key(path: Column) -> Column:
    """A path to compare by: lower case, backslashes."""
    return F.lower(F.translate(path, "/", "\\"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[\\/]"), -1)


def extension(path: Column) -> Column:
    """What stands behind the last dot of the name, lower case; empty without a dot."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise("")


def under(path: Column, folder: Column) -> Column:
    """Whether a path is the folder or lies below it, ends of names respected, case ignored."""
    p, f = path_key(path), F.rtrim(path_key(folder), F.lit("\\"))
    return (p == f) | F.startswith(p, F.concat(f, F.lit("\\")))


def stem(path: Column) -> Column:
    """The name without what stands behind its last dot; a dot at the start is part of the name."""
    return F.regexp_replace(basename(path), r"(?<=.)[.][^.]*$", "")


def parent(path: Column) -> Column:
    """What stands before the last separator; null without one."""
    return F.when(F.rlike(path, F.lit(r"[\\/]")), F.regexp_replace(path, r"[\\/][^\\/]*$", ""))


def replaced_prefix(path: Column, old: Column, new: Column) -> Column:
    """A path at or below ``old`` moved to ``new``; any other as it is."""
    return F.when(under(path, old), F.concat(new, F.substr(path, F.length(F.rtrim(F.translate(old, "/", "\\"), F.lit("\\"))) + 1))).otherwise(path)


def shell_body(target: Column) -> Column:
    """A target without a leading ``shell:AppsFolder``."""
    return F.regexp_replace(target, r"(?i)^shell:appsfolder\\?", "")


def is_shell_package(target: Column) -> Column:
    """A packaged program: an apps-folder target that is no path."""
    return F.rlike(F.trim(target), F.lit(r"(?i)^shell:appsfolder")) & ~F.rlike(shell_body(F.trim(target)), F.lit(r"[\\/]"))


#: Names of folders that lie within an installation (fixed values).
INNER_FOLDERS = "bin bin32 bin64 x86 x64 win32 win64 program programs app apps office6 office5 utility uninstall uninst".split()


def install_root(target: Column) -> Column:
    """The installation's folder: above version numbers and folders that only divide it; null for a
    target that is no path."""
    body = shell_body(F.trim(target))
    inner = rf"(?i)[\\/](?:(?=[0-9.]*[0-9])(?=[0-9.]*[.])[0-9.]+|office[0-9]*|{'|'.join(INNER_FOLDERS)})$"
    folder = parent(body)
    climbed = F.regexp_replace(folder, rf"(?:{inner[:-1].replace('(?i)', '')})+$".replace("(?:", "(?i)(?:", 1), "")
    return F.when(folder.isNotNull(), path_key(climbed))


def launch_identity(target: Column, args: Column) -> Column:
    """What is started and how: the target's key without the apps-folder prefix, and the arguments."""
    return F.concat(path_key(shell_body(F.trim(target))), F.lit("\x1f"), F.trim(F.coalesce(args, F.lit(""))))


def stable_item_id(target: Column, args: Column) -> Column:
    return hash_id(path_key(target), F.coalesce(args, F.lit("")))


def legacy_item_id(target: Column, args: Column, source: Column) -> Column:
    return hash_id(path_key(target), F.coalesce(args, F.lit("")), source)


def family_key(name: Column) -> Column:
    """Lower case, without a bracket's contents at the end, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(name)), r"(\([^(\[]*\)|\[[^(\[]*\])$", ""), r"(?U)\s+", " "))


def stem_names_family(target: Column, name: Column) -> Column:
    """Whether a program's file name is another row's family or its first word (three letters at least)."""
    s, family = F.lower(stem(shell_body(target))), family_key(name)
    return F.coalesce((F.octet_length(s) >= 3) & ~F.contains(s, F.lit(" ")) & ((family == s) | F.startswith(family, F.concat(s, F.lit(" ")))), F.lit(False))


def stem_begins_name(target: Column, name: Column) -> Column:
    """Whether a name's letters and digits begin with a program's file name (three letters at least)."""
    s, plain = F.lower(stem(shell_body(target))), F.regexp_replace(normalize(name), "[^A-Za-z0-9]", "")
    return F.coalesce((F.octet_length(s) >= 3) & (plain != "") & F.startswith(plain, s), F.lit(False))


def direct_path(text: Column) -> Column:
    """The absolute drive or network path that a text is, without one pair of quotes; else null."""
    t = F.trim(text)
    value = F.when(F.rlike(t, F.lit('^".*"$')) & (F.length(t) >= 2), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    wrong = (value == "") | F.rlike(value, F.lit('[\\x00\\r\\n"]')) | F.rlike(value, F.lit(r"^\\\\[?.]\\"))
    drive, share = F.rlike(value, F.lit(r"^[A-Za-z]:[\\/][^:]*$")), F.rlike(value, F.lit(r"^\\\\[^\\]+\\[^\\]+"))
    return F.when(~wrong & (drive | share), value)


def plugin_url_allowed(url: Column) -> Column:
    u = F.trim(url)
    return F.coalesce(F.rlike(u, F.lit(r"^(?i)https?://")) & ~F.rlike(u, F.lit("[\\x00\\r\\n]")), F.lit(False))


def plugin_path_allowed(path: Column) -> Column:
    """A drive or network path without control characters and without what a shell reads."""
    p = F.trim(path)
    plain = ~F.rlike(p, F.lit("[\\x00\\r\\n&|><^;\"'`%]"))
    place = F.rlike(p, F.lit(r"^[A-Za-z]:[\\/][^:]*$")) | (F.rlike(p, F.lit(r"^\\\\[^\\]*\\")) & ~F.rlike(p, F.lit(r"^\\\\[?.]\\")))
    return F.coalesce(plain & place, F.lit(False))


def web_id(kind: Column, browser: Column, rest: Column) -> Column:
    return F.concat(kind, F.lit(":"), browser, F.lit(":"), rest)


def parsed_web_id(item: Column) -> Column:
    """``struct<kind,browser,rest>`` of a web id; what follows the second colon is the rest; else null."""
    part = lambda k: F.regexp_extract(item, "^(url|websearch):([^:]*):((?s).*)$", k)
    return F.when(F.rlike(item, F.lit("^(url|websearch):[^:]*:")), F.struct(part(1).alias("kind"), part(2).alias("browser"), part(3).alias("rest")))


def expanded(path: Column, variables: Column) -> Column:
    """``%NAME%`` replaced by the map's value (names in upper case); unknown names stay."""
    names = F.array_distinct(F.regexp_extract_all(path, F.lit("%([^%]+)%"), F.lit(1)))
    return F.aggregate(names, path, lambda p, n: F.replace(p, F.concat(F.lit("%"), n, F.lit("%")), F.coalesce(F.try_element_at(variables, F.upper(n)), F.concat(F.lit("%"), n, F.lit("%")))))


def minified_json(text: Column) -> Column:
    """A JSON text without white space between its parts; null where it is none."""
    return F.to_json(F.try_parse_json(text))


def base64_decoded(text: Column) -> Column:
    """The UTF-8 text of a Base64 text; null where either is broken."""
    return F.try_validate_utf8(F.try_to_binary(text, F.lit("base64")).cast("string"))


def arguments_core(args: Column) -> Column:
    """Arguments without ``/from=`` tokens, single spaces; none are empty."""
    return F.array_join(F.filter(F.split(F.trim(F.coalesce(args, F.lit(""))), r"\s+"), lambda t: ~F.rlike(F.lower(t), F.lit("^(/|-|--)from="))), " ")


def arguments_equal(a: Column, b: Column) -> Column:
    """Whether two argument strings are the same, or are but for ``/from=`` tokens and spaces."""
    return arguments_core(a) == arguments_core(b)
