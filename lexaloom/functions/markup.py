"""Links, logs, questions and generated blocks in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Greetings, each a whole text, and the forms of a question about two things.
GREETINGS = [
    "(hi|hello|hey|yo|sup|howdy|hiya|heya|hullo)( there| y'all| you| folks| everyone)?",
    "good (morning|afternoon|evening|day|night)",
    "(what'?s up|wassup|whaddup)",
    "greetings",
    "(你好|您好|大家好|嗨|哈喽|哈啰|哈囉|哈罗|喂)[啊呀吖呢么呗哦哈]?",
    "(早|早啊|早安|早上好|中午好|下午好|晚上好|晚安)[啊呀吖呢么呗哦哈]?",
    "(在吗|在嗎|在不在|有人吗|有人嗎|有人在吗|有人在嗎)",
    "(こんにちは|こんばんは|おはよう|おはようございます|やあ|どうも|はじめまして)",
    "(안녕|안녕하세요|안녕하십니까)",
    "(hola|bonjour|salut|coucou|hallo|servus|hej|hejsan|ciao|saluton|ola|olá|privet|привет)",
]
COMPARISON = r"(?is)\bboth\b.{0,80}\band\b|\bcompare\b|\bvs\.?\b|\bversus\b|\(i\).{0,500}\(ii\)"
NOT_NAMES = ["What", "How", "Which", "Compare", "The", "Why", "When", "Where", "Who", "Does", "Are", "Both", "Between"]


def unwrapped_links(text: Column) -> Column:
    """Wiki links replaced by what they show."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"), r"\[\[([^\]]+)\]\]", "$1")


def markdown_links(text: Column) -> Column:
    """Wiki links as Markdown links to pages."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[([^\]|]+)\|([^\]]+)\]\]", "[$2]($1.md)"), r"\[\[([^\]|]+)\]\]", "[$1]($1.md)")


def link_slug(item: Column) -> Column:
    """What an item that is one whole wiki link leads to; another item as it is."""
    plain = F.trim(item)
    return F.when(plain.rlike(r"^\[\[[^\]|]+(\|[^\]]*)?\]\]$"), F.trim(F.regexp_extract(plain, r"^\[\[([^\]|]+)", 1))).otherwise(plain)


def ref_key(ref: Column) -> Column:
    """A reference for comparison: last segment, without extension, case, spaces, hyphens and underscores."""
    leaf = F.regexp_replace(F.element_at(F.split(F.trim(ref), "/"), -1), r"(?i)\.md$", "")
    return F.regexp_replace(F.lower(leaf), r"[\s_-]+", "")


def without_links(text: Column, keys: Column) -> Column:
    """text in which links to pages with one of the keys are plain words."""
    links = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[\[[^\]]+\]\]"), F.lit(0)))
    target = lambda l: ref_key(F.regexp_extract(l, r"^\[\[([^\]|]+)", 1))
    shown = lambda l: F.element_at(F.split(F.regexp_replace(l, r"^\[\[|\]\]$", ""), r"\|"), -1)
    return F.aggregate(F.filter(links, lambda l: F.array_contains(keys, target(l))), text, lambda t, l: F.replace(t, l, shown(l)))


def without_listing(text: Column, keys: Column) -> Column:
    """text without list lines whose first link leads to one of the keys."""
    lines = F.split(text, "\n")
    key = lambda l: ref_key(F.regexp_extract(l, r"^\s*[-*]\s*\[\[([^\]|]+)", 1))
    return F.array_join(F.filter(lines, lambda l: ~(l.rlike(r"^\s*[-*]\s*\[\[") & F.array_contains(keys, key(l)))), "\n")


def log_entry(line: Column) -> Column:
    """date, action and subject of a log header: `## [date] action | subject`, `## date action: subject` or `- date: action subject`."""
    forms = [r"^##\s*\[(\d{4}-\d{2}-\d{2})\]\s*([\w-]+)\s*\|\s*(.+?)\s*$", r"^##\s*(\d{4}-\d{2}-\d{2})\s+([\w-]+):?\s+(.+?)\s*$", r"^[-*]\s*(\d{4}-\d{2}-\d{2}):?\s*([\w-]+)\s+(.+?)\s*$"]
    part = lambda k: F.coalesce(*[F.nullif(F.regexp_extract(line, f, k), F.lit("")) for f in forms])
    return F.when(part(1).isNotNull(), F.struct(part(1).alias("date"), F.lower(part(2)).alias("action"), part(3).alias("subject")))


def is_greeting(text: Column, most: int = 20) -> Column:
    """Whether a text of at most ``most`` characters is a greeting and nothing else but punctuation behind it."""
    plain = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), r"[\s!！。.?？~,，、;；:：]+$", "")))
    return (plain != "") & (F.length(plain) <= most) & plain.rlike("^(?:" + "|".join(GREETINGS) + ")$")


def sub_queries(question: Column) -> Column:
    """One or two questions: the parts of `(i) ... (ii) ...`, else two capitalised names joined by and, vs or versus, else the question."""
    first, second = (F.trim(F.regexp_extract(question, r"(?is)\(i\)(.{1,500}?)\(ii\)(.+)$", k)) for k in (1, 2))
    a, b = (F.regexp_extract(question, r"\b([A-Z][A-Za-z]{2,})\s+(?:and|vs\.?|versus)\s+([A-Z][A-Za-z]{2,})\b", k) for k in (1, 2))
    names = (a != "") & ~a.isin(NOT_NAMES) & ~b.isin(NOT_NAMES)
    return F.when(~question.rlike(COMPARISON), F.array(question)).when((first != "") & (second != ""), F.array(first, second)).when(names, F.array(a, b)).otherwise(F.array(question))


def context_budget(size: Column) -> Column:
    """Shares of a context of size characters: response, index, pages, and the most for one page."""
    share = lambda x: F.floor(size * x)
    pages = share(0.5)
    return F.struct(share(0.15).alias("response"), share(0.05).alias("index"), pages.alias("pages"), F.least(pages, F.greatest(F.lit(5000), F.floor(pages * 0.3))).alias("page"))


def file_blocks(text: Column) -> Column:
    """path and content of blocks between `--- FILE: path ---` and `--- END FILE ---` lines."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?ims)^---\s*FILE:\s*[^\n]+?\s*---[ \t]*\r?\n.*?^---\s*END\s+FILE\s*---[ \t]*$"), F.lit(0))
    part = lambda b, k: F.regexp_extract(b, r"(?is)^---\s*FILE:\s*([^\n]+?)\s*---[ \t]*\r?\n(.*?)\r?\n?---\s*END\s+FILE\s*---[ \t]*$", k)
    return F.transform(blocks, lambda b: F.struct(part(b, 1).alias("path"), part(b, 2).alias("content")))


def review_blocks(text: Column) -> Column:
    """type, title and body of blocks between `---REVIEW: type | title---` and `---END REVIEW---`."""
    whole = r"(?s)---REVIEW:\s*\w[\w-]*\s*\|\s*[^\n]+?\s*---\n.*?---END REVIEW---"
    part = lambda b, k: F.regexp_extract(b, r"(?s)^---REVIEW:\s*(\w[\w-]*)\s*\|\s*([^\n]+?)\s*---\n(.*?)---END REVIEW---$", k)
    found = F.regexp_extract_all(text, F.lit(whole), F.lit(0))
    return F.transform(found, lambda b: F.struct(part(b, 1).alias("type"), part(b, 2).alias("title"), F.regexp_replace(part(b, 3), r"^\s+|\s+$", "").alias("body")))


def entity_rows(text: Column) -> Column:
    """name, type and description of the JSON rows of <entities> blocks; what is not JSON gives none."""
    raw = F.regexp_extract_all(text, F.lit(r"(?is)<\s*entities\s*>(.*?)<\s*/\s*entities\s*>"), F.lit(1))
    rows = F.transform(raw, lambda r: F.from_json(r, "array<struct<name:string,type:string,description:string>>"))
    return F.filter(F.flatten(F.filter(rows, lambda r: r.isNotNull())), lambda e: F.coalesce(e["name"], F.lit("")) != "")


def whole_sources(sources: Column) -> Column:
    """Sources without those that are parts of longer ones."""
    return F.filter(sources, lambda s: ~F.exists(sources, lambda o: (F.length(o) > F.length(s)) & F.contains(o, s)))


def entity_summary(content: Column, description: Column, most: int = 200) -> Column:
    """A page's description, else its first line that is no heading or table, cut to most characters."""
    lines = F.filter(F.split(content, "\n"), lambda l: (F.trim(l) != "") & ~l.rlike(r"^\s*(#|\||---|```)"))
    text = F.trim(F.coalesce(description, F.get(lines, F.lit(0)), F.lit("")))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)
