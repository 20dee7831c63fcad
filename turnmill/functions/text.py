"""Text functions: token estimates, modes, clean-up, knowledge lines, formats.  All are expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters per token.
PLAIN_RATIO = 3.0
MODE_RATIO = {"en": 3.33, "zh": 1.67, "code": 2.5, "mixed": 3.0}
CJK_SHARE, CODE_SHARE = 0.3, 0.05
CJK = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]"
CODE_SIGNS = r"[{}\[\]();=<>/\\]"
# Context windows by model name, in the order in which they are tried.
CONTEXT_WINDOWS = (
    ("claude-sonnet", 200_000), ("claude-opus", 200_000), ("claude-haiku", 200_000), ("deepseek-v4", 1_000_000),
    ("deepseek-v4-pro", 1_000_000), ("deepseek-v3", 128_000), ("deepseek-r1", 128_000),
)
DEFAULT_WINDOW = 200_000
# Marks of lines that hold knowledge.
KNOWLEDGE_MARKS = (
    "原因", "根因", "因为", "导致", "所以", "本质", "应该", "需要", "必须", "不要", "优先", "建议", "方案",
    "权衡", "修复", "验证", "测试", "检查", "失败", "错误", "问题", "结论", "发现", "风险", "约束",
)
KNOWLEDGE_HEAD = r"^(结论|原因|根因|问题|修复|方案|风险|验证|发现|建议|注意|坑|教训)[:：]"
CODE_LIKE = r"\.(tsx?|jsx?|json|md|css)|/Users/|localhost|npm |git |const |function |import "


def units(text: Column) -> Column:
    """Length in UTF-16 code units, the token basis of the logs' own tools."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def tokens(text: Column) -> Column:
    return units(text) / F.lit(PLAIN_RATIO)


def matches(text: Column, pattern: str) -> Column:
    """Number of characters that match a class of single characters."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def mode(text: Column) -> Column:
    """zh, en, code or mixed, by the shares of CJK characters and of code signs."""
    size = units(text)
    share = matches(text, CJK) / size
    return (
        F.when(size == 0, "mixed").when(share > CJK_SHARE, "zh")
        .when(share < CODE_SHARE, F.when(matches(text, CODE_SIGNS) > size * CODE_SHARE, "code").otherwise("en")).otherwise("mixed")
    )


def tokens_by_mode(text: Column, mode_: Column) -> Column:
    ratio = F.when(mode_ == "en", MODE_RATIO["en"]).when(mode_ == "zh", MODE_RATIO["zh"]).when(mode_ == "code", MODE_RATIO["code"]).otherwise(MODE_RATIO["mixed"])
    return units(text) / ratio


def context_window(model: Column) -> Column:
    """Tokens of a model's context: the first name in the table that the model's name contains."""
    name, out = F.lower(model), None
    for part, size in CONTEXT_WINDOWS:
        out = F.when(name.contains(part), size) if out is None else out.when(name.contains(part), size)
    return out.otherwise(DEFAULT_WINDOW).cast("long")


def normal(text: Column) -> Column:
    """CRLF to LF, blanks and tabs to one blank, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def trimmed(text: Column) -> Column:
    """Without white space (ASCII) at either end; no pattern, which would try each blank of the text."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def compact(text: Column, most: int) -> Column:
    """The normal text, or its head and tail with the number of characters left out between them."""
    whole = normal(text)
    head, tail = trimmed(F.substring(whole, 1, most * 72 // 100)), trimmed(F.expr("''") if most * 20 // 100 == 0 else F.right(whole, F.lit(most * 20 // 100)))
    cut = F.concat(head, F.lit("\n...[中间省略 "), (units(whole) - units(head) - units(tail)).cast("string"), F.lit(" 字]...\n"), tail)
    return F.when(units(whole) <= most, whole).otherwise(cut)


def knowledge_score(line: Column) -> Column:
    """How much a line looks like a finding rather than like code."""
    score = F.lit(0)
    for mark in KNOWLEDGE_MARKS:
        score = score + F.when(line.contains(mark), 3).otherwise(0)
    bare = trimmed(line)
    return (
        score + F.when(bare.rlike(KNOWLEDGE_HEAD), 6).otherwise(0) + F.when(bare.rlike("[。；;]$"), 1).otherwise(0)
        - F.when(line.rlike(r"[{}()\[\]<>]"), 2).otherwise(0) - F.when(line.rlike(CODE_LIKE), 3).otherwise(0)
        - F.when(units(line) < 18, 2).otherwise(0) - F.when(units(line) > 280, 1).otherwise(0)
    ).cast("long")


def may_score(line: Column) -> Column:
    """Cheap and true of each line of a knowledge_score() above 0: only marks, which aren't ASCII, and semicolons at the end add to it."""
    return (F.octet_length(line) > F.char_length(line)) | line.rlike(r";\s*$")


def xml_escaped(text: Column) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def masked(key: Column) -> Column:
    """A secret's first and last four characters; short ones not at all."""
    return F.when(F.char_length(key) <= 8, "***").otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(4))))


def compact_number(x: Column) -> Column:
    """1234567 as 1.23M, 12345 as 12.35K, smaller ones as they are."""
    two = lambda size: F.format_string("%.2f", F.floor(x / (size / 100) + 0.5) / 100)
    return F.when(x >= 1e6, F.concat(two(1e6), F.lit("M"))).when(x >= 1e3, F.concat(two(1e3), F.lit("K"))).otherwise(F.format_string("%d", x.cast("long")))


def fnv_slot(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 units, folded to 930000000 ... 930099999."""
    raw = F.encode(text, "UTF-16BE")
    code = lambda i: F.conv(F.hex(F.substring(raw, i * 2 + 1, F.lit(2))), 16, 10).cast("long")
    at = F.when(units(text) > 0, F.sequence(F.lit(0), (units(text) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    step = lambda h, i: (h.bitwiseXOR(code(i)) * F.lit(16_777_619)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(at, F.lit(2_166_136_261).cast("long"), step) % 100_000 + 930_000_000


def instant_ms(raw: Column) -> Column:
    """Epoch numbers below 1e12 are seconds, others milliseconds."""
    return F.when(F.abs(raw) < 1e12, raw * 1000).otherwise(raw).cast("long")


def gap_ms(start: Column, end: Column) -> Column:
    """Milliseconds from start to end, never below 0; 0 if either is missing."""
    return F.greatest(F.lit(0), F.coalesce(F.unix_millis(end) - F.unix_millis(start), F.lit(0))).cast("long")


def characters(text: Column) -> Column:
    """The distinct characters of a text."""
    return F.array_distinct(F.split(text, ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def decoded(text: Column) -> Column:
    """The five common entities as characters; &amp; last, so that nothing is decoded twice."""
    for name, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(sign))
    return text


# A numbered line, words of code, tags of cards by what the text says, and marks of instructions.
NUMBERED_LINE = r"^\s*\d+:\s*\S"
CODE_WORD = r"\b(import|export|const|let|var|function|class|return|if|for|while|async|await|def|from|require)\b"
VAULT_TAGS = (
    ("智能体|Agent|agent|子代理|subagent|主代理", "领域/智能体"),
    ("软件工程|代码库|代码执行|源码|项目结构|代码重构|工程重构", "领域/软件工程"),
    ("(?i)知识管理|知识库|Obsidian|标签体系|vault", "领域/知识管理"),
    ("(?i)本体建模|本体构建|本体图谱|ontology", "领域/本体"),
    ("数字分身|数字人|张大仙|大仙", "领域/数字分身"),
    ("代码执行|执行分析|工具调用", "主题/代码执行分析"),
    ("代码库|源码|项目结构|大型代码", "主题/代码库分析"),
    ("角色扮演", "主题/角色扮演训练"),
    ("模型训练|微调|训练|LoRA|DPO|loss|embedding|词表", "主题/模型训练"),
)
INSTRUCTION_MARKS = (
    ("<skills_instructions>", "skills"), ("<plugins_instructions>", "mcp"), ("<permissions instructions>", "reminders"),
    ("<collaboration_mode>", "reminders"), ("<app-context>", "reminders"),
)


def looks_like_code(text: Column) -> Column:
    """Two lines or more that aren't blank, and enough of them numbered or with a word of code."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\S"))
    n = F.size(lines)
    numbered, words = F.size(F.filter(lines, lambda x: x.rlike(NUMBERED_LINE))), F.size(F.filter(lines, lambda x: x.rlike(CODE_WORD)))
    share = lambda k, of: k >= F.lit(of) * n
    return (n >= 2) & (share(numbered, 0.6) | (share(numbered, 0.3) & (words >= 2)) | share(words, 0.3) | (words >= 5))


def looks_like_diff(text: Column) -> Column:
    """A line that begins a git diff, or a row of a table with a diff's sign above the line below its head."""
    lines = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return lines.rlike(r"(^|\n)[^\S\n]*diff --git [^\n]*\S") | lines.rlike(r"(^|\n)[+\- ]\|[^\n]*\|[^\S\n]*\n\s?\|[\s\-:|]+\|[^\S\n]*(\n|$)")


def vault_tags(text: Column) -> Column:
    """Tags of a card by what its text says, in their fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(tag)) for pattern, tag in VAULT_TAGS]))


def instruction_kind(text: Column) -> Column:
    """What a developer's instruction is about, by the first of its marks."""
    out = None
    for mark, kind in INSTRUCTION_MARKS:
        out = F.when(text.contains(mark), kind) if out is None else out.when(text.contains(mark), kind)
    return out.otherwise("sysPrompt")
