"""Text functions of memory retrieval and governance, as column expressions.

Four estimates of tokens are kept apart on purpose: budgets of different parts of the model are stated in different ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[A-Za-z0-9]+|[一-鿿]"

# The domains' names, their order and their keywords.
DOMAIN_KEYWORDS: dict[str, tuple[str, ...]] = {
    "crypto_investment": ("btc", "eth", "bitcoin", "ethereum", "crypto", "usdt", "合约", "现货", "杠杆", "爆仓", "加密货币", "虚拟货币", "逐仓", "全仓"),
    "finance": ("bank", "payment", "supplier", "account", "invoice", "transfer", "银行", "付款", "供应商", "账户", "转账", "汇率", "对账", "工资", "制裁"),
    "coding": ("python", "code", "coding", "debug", "exception", "traceback", "代码", "编程", "报错", "异常", "调试"),
    "writing": ("writing", "report", "reply", "complaint", "document", "写作", "报告", "回复", "投诉", "文稿"),
    "research": ("research", "paper", "literature", "citation", "研究", "论文", "文献", "引用"),
}
# Other names of the domains.
DOMAIN_ALIASES = {"crypto": "crypto_investment", "cryptocurrency": "crypto_investment", "banking": "finance", "code": "coding"}


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and single Chinese characters, in lower case and in order (FN1 before distinct)."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def singular(token: Column) -> Column:
    """Without an s at the end, for tokens of over three characters (FN3). Tokens are ASCII where they end in one."""
    return F.when(token.endswith("s") & (F.length(token) > 3), F.left(token, F.length(token) - 1)).otherwise(token)


def semantic_set(text: Column) -> Column:
    return F.array_distinct(F.transform(tokens(text), singular))


def jaccard(a: Column, b: Column) -> Column:
    """Zero where either is empty (SET7)."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def normalized(text: Column) -> Column:
    """White space runs as one space, trimmed, in lower case (FN6)."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def domain(value: Column) -> Column:
    """A domain's canonical name; blank is none."""
    v = F.lower(F.trim(value))
    aliased = reduce(lambda e, kv: F.when(v == kv[0], kv[1]).otherwise(e), DOMAIN_ALIASES.items(), v)
    return F.when(v != "", aliased)


def inferred_domain(text: Column) -> Column:
    """The domain with most keywords in the text, the first named of equals, none without any (FN4)."""
    low = F.lower(text)
    hits = {d: reduce(Column.__add__, (low.contains(k).cast("int") for k in words)) for d, words in DOMAIN_KEYWORDS.items()}
    best = F.greatest(*hits.values())
    return F.when(best > 0, F.coalesce(*(F.when(n == best, F.lit(d)) for d, n in hits.items())))


def t1(contents_length: Column) -> Column:
    """Estimate by total characters: at least 1, a quarter rounded up."""
    return F.greatest(F.lit(1), F.ceil(contents_length / 4)).cast("long")


def t2(text: Column) -> Column:
    """Estimate for one block: a quarter, rounded half up."""
    return F.floor(F.length(text) / 4 + 0.5).cast("long")


def t3(text: Column) -> Column:
    """Estimate by regular expression: the number of tokens."""
    return F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).cast("long")


def first_tokens(text: Column, n: int) -> Column:
    """The text up to the end of its nth token, all of it where there are fewer (FN31).

    The ends are added up from the tokens and the gaps between them, so no expression has to look back.
    """
    chars = lambda parts: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.when(F.size(found) <= n, text).otherwise(F.left(text, chars(F.split(text, TOKEN)) + chars(found)))


def rstripped(text: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(text, r"\s+$", "")


def t4(response_length: Column, transcript_length: Column) -> Column:
    """Estimate for a completed task: at least 1, a quarter rounded up in whole numbers."""
    return F.greatest(F.lit(1).cast("long"), F.floor((response_length + transcript_length + 3) / 4)).cast("long")


def marker_hashes(text: Column) -> Column:
    """Recall markers: all of the form hash=… first, then all of the form <<ccr:…, each once (GRP5)."""
    named = F.regexp_extract_all(text, F.lit("hash=([0-9a-fA-F]{12,128})"), F.lit(1))
    tagged = F.regexp_extract_all(text, F.lit("<<ccr:([0-9a-zA-Z_-]+)"), F.lit(1))
    return F.array_distinct(F.concat(named, tagged))


def stable_id(prefix: str, *parts: Column, length: int = 16) -> Column:
    """prefix and the first characters of the SHA-256 of the parts (FN15)."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\n", *parts), 256), F.lit(length)))


def slug(text: Column, length: int = 64) -> Column:
    """Lower case letters and digits with single dashes between (FN28)."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", ""), F.lit(length))


def clamped_confidence(value: Column, default: float = 0.0) -> Column:
    """A number between 0 and 1, the default where it is none (FN20)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(default))))


def recency(updated_at: Column, as_of: Column, most: float = 0.05, days: int = 365) -> Column:
    """``most`` for now, falling in a line to 0 after ``days``; 0 without a time (FN21)."""
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of) - F.unix_micros(updated_at)) / 86_400_000_000)
    return F.coalesce(F.greatest(F.lit(0.0), most * (1 - F.least(age, F.lit(float(days))) / days)), F.lit(0.0))


def backoff(attempt: Column, base: float, most: float) -> Column:
    """Exponential wait before an attempt (FN32)."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def coerced(value: Column) -> Column:
    """A dynamic scalar with its type: boolean, integer, number or string, the first that fits (FN14)."""
    low = F.lower(F.trim(value))
    kind = F.when(low.isin("true", "false"), "bool").when(F.trim(value).rlike(r"^[+-]?\d+$"), "int").when(F.trim(value).try_cast("double").isNotNull(), "float").otherwise("str")
    return F.struct(kind.alias("value_type"), F.when(kind == "bool", low).when(kind == "str", value).otherwise(F.trim(value)).alias("value"))
