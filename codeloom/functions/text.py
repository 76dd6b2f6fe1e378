"""Text column builders: chunk windows, token budgets, keywords, literal detection, lint matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalars import CHARS_PER_TOKEN

#: Characters of a chunk window and of its overlap.
WINDOW_CHARS, OVERLAP_CHARS = 2048, 256
#: Fixed words that carry no search intent.
STOPWORDS = (
    "a", "an", "the", "and", "or", "of", "to", "in", "for", "on", "with",
    "is", "are", "was", "be", "by", "at", "as", "it", "its", "from", "how",
    "can", "do", "use", "get", "set", "has",
)
#: Fixed words of rule messages that tell no rules apart.
LINT_STOPWORDS = (
    "with", "from", "this", "that", "have", "must", "should",
    "function", "usage", "literal", "string", "alias", "option",
    "the", "and", "use", "not", "for", "are", "when", "avoid",
    "call", "called", "calling", "instead", "please", "using",
)
#: At-rules that are no literal style names, and what stands between parts of a selector.
AT_RULES = ("@media", "@import", "@supports", "@keyframes", "@font-face", "@charset", "@namespace", "@layer", "@container")
COMBINATORS = (">", "~", "+", "||")
#: Lines of code longer than this are not matched against patterns.
LINT_LINE_CHARS = 4000
KEYWORD_CHARS = 3


def window_starts(size: Column, window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> Column:
    """0-based starts of sliding windows; the last window is the first that reaches the end."""
    step = window - overlap
    last = F.when(size > window, F.ceil((size - window) / step).cast("int")).otherwise(F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: k * step)


def budget_pieces(text: Column, budget: int, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    """Slices of ``budget`` tokens' characters; a text that fits, or a budget below one, gives one piece."""
    size = int(budget * chars_per_token)
    if size <= 0:
        return F.array(text)
    count = F.ceil(F.length(text) / size).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.substring(text, k * size + 1, F.lit(size)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(cut)


def chunks(df: DataFrame, text_col: str = "text", budget: int | None = None, window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """A row for each chunk: ``chunk_idx`` runs through windows and their budget pieces. Empty texts give none."""
    text = F.col(text_col)
    windows = F.transform(window_starts(F.length(text), window, overlap), lambda s: F.substring(text, s + 1, F.lit(window)))
    pieces = windows if budget is None else F.flatten(F.transform(windows, lambda w: budget_pieces(w, budget)))
    keep = df.filter(F.length(text) > 0)
    return keep.select(*[c for c in df.columns if c != text_col], F.posexplode(pieces).alias("chunk_idx", "content"))


def keywords(text: Column) -> Column:
    """Lower-case words of at least three characters, in order, once each, without stopwords and outer dots."""
    words = F.transform(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}_.]+"), lambda w: F.regexp_replace(w, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= KEYWORD_CHARS) & ~w.isin(*STOPWORDS)))


def _bare_name(t: Column) -> Column:
    return t.rlike(r"^[A-Za-z_][\w-]{1,63}$") & t.rlike("[-_]")


def style_literal(text: Column) -> Column:
    """Whether a style query names something as it is written: a variable, a selector, all parts of a descendant selector, or a compound name.

    Plain words and at-rules are not literal.
    """
    t = F.trim(F.coalesce(text, F.lit("")))
    one = ~F.contains(t, F.lit(" ")) & (F.length(t) > 1)
    part = lambda p: p.isin(*COMBINATORS) | F.when(p.rlike(r"^[.#\[&*>~+:$@]"), F.length(p) > 1).otherwise(_bare_name(p))
    return (
        F.when((t == "") | F.lower(t).isin(*AT_RULES), False).when(t.rlike(r"^[$@\[&*>~+:]"), one)
        .when(t.rlike(r"^[.#]"), F.when(F.contains(t, F.lit(" ")), F.forall(F.split(t, r"\s+"), part)).otherwise(F.length(t) > 1)).otherwise(_bare_name(t))
    )


def literal_column(text: Column) -> Column:
    """Which column a literal style name is looked for in: variables stand in ``content``, all else in ``entity_name``."""
    return F.when(F.trim(text).rlike(r"^[$@]"), "content").otherwise("entity_name")


def lint_tokens(text: Column) -> Column:
    """Distinct words of letters and underscores, longer than three characters, that tell rules apart."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z_]+"), lambda w: (F.length(w) > 3) & ~w.isin(*LINT_STOPWORDS)))


def fuzzy_lint(message: Column, line: Column, least: int = 2) -> Column:
    """Whether a line shares at least two words with a rule's message."""
    return F.size(F.array_intersect(lint_tokens(message), F.split(F.lower(line), "[^a-z_]+"))) >= least


def noqa_rules(line: Column) -> Column:
    """Null without a noqa mark; ``*`` for a bare one (all rules); else the rules it lists. Letter case counts."""
    mark = r"#\s*noqa(?::\s*([A-Za-z0-9,\s]+))?"
    listed = F.filter(F.transform(F.split(F.regexp_extract(line, mark, 1), ","), F.trim), lambda r: r != "")
    return F.when(line.rlike(r"#\s*noqa"), F.when(F.regexp_extract(line, mark, 1) == "", F.array(F.lit("*"))).otherwise(listed))


def suppressed(line: Column, rule: Column) -> Column:
    rules = noqa_rules(line)
    return F.coalesce(F.array_contains(rules, F.lit("*")) | F.array_contains(rules, rule), F.lit(False))


def chunk_header(kind: Column, module: Column, version: Column, owner: Column, name: Column, detail: Column) -> Column:
    """The line that a chunk's text begins with: what it is and where it stands, so that searches meet it.

    ``owner`` is the model or test class, ``detail`` a field's or view's type (with its parent), or what a test covers.
    """
    at = F.concat(F.lit("["), module, F.lit("] "))
    inside = lambda a, b: F.concat(F.lit("("), a, b, F.lit(")"))
    none = F.lit("")
    return (
        F.when(kind == "method", F.concat(at, owner, F.lit("."), name, F.lit(" "), inside(version, none)))
        .when(kind == "field", F.concat(at, owner, F.lit(": "), name, F.lit(" "), inside(detail, none)))
        .when(kind == "view", F.concat(at, name, F.lit(" "), inside(detail, none)))
        .when(kind == "qweb", F.concat(at, name))
        .when(kind == "test_method", F.concat(F.lit("[test] "), F.coalesce(detail, F.lit("<no model ref>")), F.lit(" via "), owner, F.lit("."), name,
            F.lit(" "), inside(version, none)))
        .when(kind == "test_class", F.concat(F.lit("[test class] "), name, inside(F.coalesce(detail, F.lit("object")), none), F.lit(" in "), module,
            F.lit(" "), inside(version, none)))
    )


def headed(kind: Column, header: Column, body: Column) -> Column:
    """A chunk's text; kinds without a header (scripts and styles) are their bodies."""
    return F.when(header.isNull(), body).otherwise(F.concat_ws("\n", header, body))


#: Test names and mocked models that a script suite's text lists.
SUITE_NAMES, SUITE_MOCKS = 10, 5


def suite_text(framework: Column, path: Column, version: Column, describes: Column, names: Column, mounts: Column, tags: Column, mocks: Column) -> Column:
    """A script suite's chunk: what it is and where, then a line for each list that isn't empty; of the test names the first ten."""
    line = lambda label, c, most=None: F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(c if most is None else F.slice(c, 1, most), ", ")))
    more = F.when(F.size(names) > SUITE_NAMES, F.concat(F.lit("(+ "), F.size(names) - SUITE_NAMES, F.lit(" more tests)")))
    head = F.concat(F.lit("[js:"), framework, F.lit("] "), path, F.lit(" ("), version, F.lit(")"))
    return F.concat_ws("\n", head, line("describe: ", describes), line("tests: ", names, SUITE_NAMES), more, line("mounts: ", mounts), line("tags: ", tags), line("mock_models: ", mocks, SUITE_MOCKS))


def pattern_text(snippet: Column, gotchas: Column) -> Column:
    """A curated pattern's chunk: its snippet, then what to look out for."""
    return F.when(F.size(gotchas) > 0, F.concat_ws("\n", snippet, F.lit("---"), F.array_join(gotchas, "\n"))).otherwise(snippet)


def pattern_entity(language: Column, pattern_id: Column) -> Column:
    return F.concat_ws("__", language, pattern_id)


def style_entity(language: Column, kind: Column, name: Column) -> Column:
    """SCSS and LESS chunks are named by kind and name, those of CSS by name alone."""
    return F.when(language.isin("scss", "less"), F.concat_ws(":", kind, name)).otherwise(name)
