"""The reader's small rules as column expressions: progress, labels of errors and pages, geometry, prompts, settings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.gate import has

# Widths by the characters of a source, ceilings of an answer, and what a request costs beside its text.
WIDTHS, WIDTH, RETRY_WIDTH = [(4300, 1780), (2800, 1640)], 1500, 2050
CEILINGS, CEILING = [(4300, 8192), (2600, 6144)], 4096
PROMPT_TOKENS, IMAGE_TOKENS = 600, 1100
PAGE_ORDER = [0, -1, 1, 2, 3]
TABLE_DETECTORS, TABLE_CONFIDENCE, TABLE_CELLS = ["pymupdf-layout", "pymupdf-ruled-text"], 0.9, 512
FETCH_STATUSES = [408, 425, 429, 502, 503, 504]
FETCH_CODES = ["ECONNRESET", "ECONNREFUSED", "EHOSTUNREACH", "ENETDOWN", "ENETUNREACH", "ETIMEDOUT", "UND_ERR_CONNECT_TIMEOUT", "UND_ERR_SOCKET"]
FETCH_MESSAGES = r"failed to fetch|fetch failed|networkerror|network request failed|load failed"
SECRET_PARAMETER = r"(?i)[?&](?:key|api_key|apikey|api-key|x-api-key|token|access_token)(?:=|&|$)"
PROFILE_STOP_WORDS = "the and for with from that this into using based".split()
EXCERPT = 1500
CONTEXT_MARKER, EXCERPT_MARKER = "Context (for reference only, do not translate):", "Translate only this excerpt:"
ASKED = {"explain": "请解释这段内容：", "plain": "请用通俗白话解释这段内容，尽量少用术语：", "why": "请说明这段内容在论证什么、为什么这样写："}
GLOSSARY_HEAD = [
    "## User-locked terminology (MUST follow)",
    "Whenever a source term below (case-insensitive, including plural/inflected forms) appears, translate it EXACTLY as the given target text. Never invent an alternative translation for these terms:",
]
#: Patterns of error texts and what readers are told, in order; an unknown text is shown itself, clipped.
ERROR_LABELS = [
    (r"(?i)api\s*key|missing.?key|尚未配置", "尚未配置可用的模型，请先打开设置。"),
    (r"(?i)401|403|unauthori[sz]ed|forbidden|鉴权|认证", "模型授权失败，请检查当前供应商的 API Key。"),
    (r"(?i)429|rate.?limit|quota|额度|频率", "模型服务繁忙或额度不足，请稍后重试。"),
    (r"(?i)translation_queue_timeout|排队(?:等待)?超时", "排队等待超时：前方任务较多（多篇并行时更常见），请稍后重试本页。"),
    (r"(?i)timed?\s*out|timeout|超时|无响应", "模型响应较慢，本页可以稍后重试。"),
    (r"(?i)与后台的连接|连接已断开|后台.*断开|后台.*重载|扩展.*更新|extension context invalidated|receiving end does not exist|could not establish connection|message port closed|disconnected port|ping 超时|Translation port disconnected", "与后台连接中断（同时翻译多篇、扩展重载或浏览器回收后台时较常见）。请点「重试本页」或顶部「重试」；仍不行请刷新阅读器标签页。"),
    (r"(?i)failed to fetch|network|fetch failed|load failed|连接.*中断", "网络连接中断，请检查模型服务后重试。"),
    (r"(?i)\b5\d\d\b|bad gateway|service unavailable|模型.*空|empty response", "模型服务暂时不可用，请稍后重试。"),
    (r"(?i)placeholder|占位符|公式.*校验", "公式保护校验未通过，原公式已保留，请重试本页。"),
]
NO_ERROR = "本页暂时未完成，请重试。"
SELF_TALK = r"(?i)\n(?:(?:Wait[,.]?\s+let me|Let me (?:look|check|think|re-?read)|Actually[,.]?\s+wait)\b|(?:Hmm[,.]?\s+|Okay[,.]?\s+so\b))"


def _tier(value: Column, tiers: list[tuple[int, int]], otherwise: int) -> Column:
    return F.coalesce(*[F.when(value >= least, F.lit(own)) for least, own in tiers], F.lit(otherwise))


def render_width(source_chars: Column, retry: Column) -> Column:
    return F.when(retry, RETRY_WIDTH).otherwise(_tier(F.greatest(F.lit(0), F.coalesce(source_chars, F.lit(0))), WIDTHS, WIDTH))


def answer_ceiling(prompt: Column, formula: Column) -> Column:
    """Tokens that an answer may have, by the characters of the source hint in the prompt."""
    hint = F.regexp_extract(F.coalesce(prompt, F.lit("")), r"(?is)SOURCE_TEXT_HINT_BEGIN\s*\n(.*?)\nSOURCE_TEXT_HINT_END", 1)
    return F.when(formula, CEILING).otherwise(_tier(F.char_length(F.regexp_replace(hint, r"(?U)\s+", "")), CEILINGS, CEILING))


def request_tokens(text: Column, extra: Column, full: Column, image: Column) -> Column:
    """struct<prompt, completion>."""
    prompt = T.estimated_tokens(text) + T.estimated_tokens(extra) + PROMPT_TOKENS + F.when(image, IMAGE_TOKENS).otherwise(0)
    return F.struct(prompt.cast("long").alias("prompt"), T.estimated_tokens(full).cast("long").alias("completion"))


def page_order(current: Column, pages: Column) -> Column:
    """The open page, the one before it and the three after it, as far as there are such; pages count from 0."""
    near = F.array(*[(current + d).cast("int") for d in PAGE_ORDER])
    return F.filter(near, lambda p: (p >= 0) & (p < pages))


def page_point(x: Column, y: Column, turn: Column) -> Column:
    """struct<x, y> of a point on a turned page, on the page as it is."""
    quarter = F.pmod(F.floor(turn / 90 + 0.5), F.lit(4))
    px = F.when(quarter == 1, y).when(quarter == 2, 1 - x).when(quarter == 3, 1 - y).otherwise(x)
    py = F.when(quarter == 1, 1 - x).when(quarter == 2, 1 - y).when(quarter == 3, x).otherwise(y)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(px.alias("x"), py.alias("y")))


def valid_box(box: Column) -> Column:
    x0, y0, x1, y1 = (F.get(box, i) for i in range(4))
    return F.coalesce((F.size(box) == 4) & (x0 >= 0) & (y0 >= 0) & (x1 <= 1) & (y1 <= 1) & (x1 > x0) & (y1 > y0), F.lit(False))


def target_boxes(fragments: Column, union: Column) -> Column:
    """The valid ones of a target's fragments, or else its union box if that is valid."""
    whole = F.filter(fragments, valid_box)
    return F.when(F.coalesce(F.size(whole), F.lit(0)) > 0, whole).when(valid_box(union), F.array(union)).otherwise(F.array().cast("array<array<double>>"))


def scroll_delta(top: Column, height: Column, ratio: Column, viewport: Column) -> Column:
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(ratio, F.lit(0.0))))
    return F.when(top.isNotNull(), top + inside * F.greatest(F.lit(1.0), height) - F.coalesce(viewport, F.lit(0.0))).otherwise(0.0)


def centre_ratio(top: Column, height: Column, page_top: Column, page_height: Column) -> Column:
    """Where a block's centre is on its page, 0 to 1; one half without a page."""
    given = lambda c: F.coalesce(c, F.lit(0.0))
    at = (given(top) + given(height) / 2 - given(page_top)) / page_height
    return F.when(page_height > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), at))).otherwise(0.5)


def reader_progress(total: Column, done: Column, running: Column, issues: Column) -> Column:
    """struct<label, detail, tone, percent> of a document's pages."""
    s = lambda c: c.cast("string")
    total = F.greatest(F.lit(0), total)
    done = F.least(total, F.greatest(F.lit(0), done))
    pages, percent = F.concat(s(done), F.lit("/"), s(total)), F.when(total > 0, F.floor(done / total * 100 + 0.5)).otherwise(0).cast("int")
    row = lambda label, detail, tone, p: F.struct(label.alias("label"), detail.alias("detail"), F.lit(tone).alias("tone"), p.alias("percent"))
    return (
        F.when(total == 0, row(F.lit(""), F.lit(""), "idle", F.lit(0)))
        .when(done >= total, row(F.concat(pages, F.lit(" 页")), F.concat(F.lit("全文翻译完成 · "), s(total), F.lit(" 页")), "success", F.lit(100)))
        .when(issues > 0, row(F.concat(pages, F.lit(" · "), s(issues), F.lit("待处理")), F.concat(pages, F.lit(" 页完成 · "), s(issues), F.lit(" 页待处理")), "warning", percent))
        .when(running > 0, row(F.concat(pages, F.lit(" 页")), F.concat(F.lit("正在翻译 · "), pages, F.lit(" 页完成")), "busy", percent))
        .otherwise(row(F.concat(F.lit("0/"), s(total), F.lit(" 页")), F.concat(F.lit("准备翻译 · 共 "), s(total), F.lit(" 页")), "idle", percent))
    )


def page_state(active: Column, phase: Column, outcome: Column, error: Column, warned: Column, unresolved: Column) -> Column:
    """struct<label, tone, retry> of one page."""
    row = lambda label, tone, retry: F.struct((label if isinstance(label, Column) else F.lit(label)).alias("label"), F.lit(tone).alias("tone"), F.lit(retry).alias("retry"))
    return (
        F.when(active & warned, row("精修中 · 译文可读", "warning", False))
        .when(active, row(F.when(phase == "waiting-layout", "正在识别版面").otherwise("正在翻译"), "busy", False))
        .when(warned, row("译文可读 · 待精修", "warning", True))
        .when((outcome == "failed") | (F.coalesce(error, F.lit("")) != ""), row("需要重试", "error", True))
        .when(outcome == "done", row("已完成", "success", False))
        .when(outcome == "partial", row(F.when(unresolved > 0, F.concat(unresolved.cast("string"), F.lit(" 处待补全"))).otherwise("部分待补全"), "warning", True))
        .otherwise(row("等待翻译", "idle", False))
    )


def card(title: Column, last_page: Column, total: Column, translated: Column) -> Column:
    """struct<title, percent, subtitle> of a library card."""
    name = F.regexp_replace(title, r"(?i)\.pdf$", "")
    percent = F.when(total > 0, F.least(F.lit(100), F.floor(last_page / total * 100 + 0.5))).otherwise(0).cast("int")
    s = lambda c: c.cast("string")
    read = F.concat(F.lit("读到第 "), s(last_page), F.lit(" / "), s(total), F.lit(" 页"), F.when(translated > 0, F.concat(F.lit(" · 已译 "), s(translated), F.lit(" 页"))).otherwise(""))
    return F.struct(F.when(F.char_length(name) > 60, F.concat(F.left(name, F.lit(57)), F.lit("…"))).otherwise(name).alias("title"), percent.alias("percent"), F.when(total > 0, read).otherwise("尚未开始").alias("subtitle"))


def offers_resume(page: Column, pages: Column) -> Column:
    return F.coalesce((page >= 2) & ((F.coalesce(pages, F.lit(0)) == 0) | (page <= pages)), F.lit(False))


def retry_label(attempt: Column, delay_ms: Column) -> Column:
    seconds, n = F.greatest(F.lit(1), F.ceil(F.coalesce(delay_ms, F.lit(0)) / 1000)), F.greatest(F.lit(1), F.floor(F.coalesce(attempt, F.lit(1))))
    return F.concat(seconds.cast("string"), F.lit("s 后自动重试（第 "), n.cast("string"), F.lit(" 次）"))


def error_label(error: Column) -> Column:
    raw = T.trimmed(F.coalesce(error, F.lit("")))
    known = [F.when(has(raw, pattern), F.lit(said)) for pattern, said in ERROR_LABELS]
    return F.coalesce(F.when(raw == "", F.lit(NO_ERROR)), *known, F.when(F.char_length(raw) > 120, F.concat(F.left(raw, F.lit(117)), F.lit("…"))).otherwise(raw))


def fetch_may_pass(status: Column, code: Column, name: Column, message: Column, cancelled: Column) -> Column:
    """Whether a failed request may work when it is made again."""
    stopped = F.coalesce(cancelled, F.lit(False)) | (F.coalesce(name, F.lit("")) == "AbortError")
    transport = F.coalesce(name, F.lit("")).isin("TypeError", "NetworkError") & F.lower(F.coalesce(message, F.lit(""))).rlike(FETCH_MESSAGES)
    return ~stopped & (F.coalesce(status, F.lit(0)).isin(FETCH_STATUSES) | F.upper(F.coalesce(code, F.lit(""))).isin(FETCH_CODES) | transport)


def profile_fault(name: Column, key: Column, model: Column, protocol: Column, url: Column) -> Column:
    """What is wrong with a provider's profile, empty if nothing is."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    raw = F.trim(F.coalesce(url, F.lit("")))
    host = F.lower(F.regexp_extract(raw, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1))
    local = host.isin("localhost", "127.0.0.1", "[::1]", "::1")
    return F.coalesce(
        F.when(blank(name) | blank(key) | blank(model), F.lit("incomplete")),
        F.when(~F.coalesce(protocol, F.lit("")).isin("openai", "gemini"), F.lit("protocol")),
        F.when(raw == "", F.lit("no-url")),
        F.when(host == "", F.lit("bad-url")),
        F.when(~raw.rlike(r"(?i)^https://") & ~(raw.rlike(r"(?i)^http://") & local), F.lit("not-https")),
        F.when(raw.rlike(r"^[^:]+://[^/?#]*@"), F.lit("credentials")),
        F.when(F.contains(raw, F.lit("#")), F.lit("fragment")),
        F.when(raw.rlike(SECRET_PARAMETER), F.lit("secret-parameter")),
        F.lit(""),
    )


def base_url(url: Column) -> Column:
    """Without slashes at the path's end."""
    return F.regexp_replace(F.trim(url), r"/+(?=\?|$)", "")


def profile_keywords(*parts: Column, most: int = 8) -> Column:
    """English words of a profile in order, each once whatever its case, without stop words."""
    words = T.all_matches(F.concat_ws(" ", *parts), "([A-Za-z][A-Za-z0-9+_-]{2,})")
    lower = F.transform(words, lambda w: F.lower(w))
    first = T.bound(F.arrays_zip(words.alias("w"), lower.alias("l")), lambda z: F.filter(z, lambda x, i: (F.array_position(F.transform(z, lambda y: y["l"]), x["l"]) == i + 1) & ~x["l"].isin(PROFILE_STOP_WORDS)))
    return F.slice(F.transform(first, lambda x: x["w"]), 1, most)


def ui_settings(theme: Column, linked: Column, auto: Column, bilingual: Column, width: Column, default_width: int = 420) -> Column:
    wide = F.floor(F.coalesce(width, F.lit(0.0)) + 0.5).cast("int")
    return F.struct(F.when(theme == "dark", "dark").otherwise("light").alias("theme"), F.coalesce(linked, F.lit(True)).alias("linked"), F.coalesce(auto, F.lit(False)).alias("auto"), F.coalesce(bilingual, F.lit(False)).alias("bilingual"), F.when(wide.between(300, 1200), wide).otherwise(default_width).alias("width"))


def link_setting(address: Column, enabled: Column, most: int = 500) -> Column:
    """struct<address, enabled> of a linked project or folder; null if the address is blank."""
    clean = F.trim(F.coalesce(address, F.lit("")))
    return F.when(clean != "", F.struct(F.left(clean, F.lit(most)).alias("address"), F.coalesce(enabled, F.lit(True)).alias("enabled")))


def selection_request(selection: Column, before: Column, after: Column) -> Column:
    """What is sent to translate a selection, with the text around it if there is any."""
    own, a, b = T.one_line(selection), T.one_line(before), T.one_line(after)
    around = F.array_join(F.filter(F.array(a, own, b), lambda x: x != ""), " ")
    marked = F.concat_ws("\n", F.lit(CONTEXT_MARKER), around, F.lit(""), F.lit(EXCERPT_MARKER), own)
    return F.when(own == "", "").when((a == "") & (b == ""), own).otherwise(marked)


def _quoted(lead: Column, excerpt: Column, around: Column) -> Column:
    more = F.when((around != "") & (around != excerpt), F.concat(F.lit("\n\n（上下文参考："), around, F.lit("）"))).otherwise("")
    return F.concat(lead, F.lit("\n\n“"), excerpt, F.lit("”"), more)


def selection_question(selection: Column, around: Column, intent: Column, most: int = EXCERPT) -> Column:
    excerpt, context = (F.left(T.one_line(c), F.lit(most)) for c in (selection, around))
    lead = F.coalesce(*[F.when(intent == k, F.lit(v)) for k, v in ASKED.items()], F.lit(ASKED["explain"]))
    return F.when((excerpt == "") | (intent == "custom"), "").otherwise(_quoted(lead, excerpt, context))


def message_with_quote(question: Column, selection: Column, around: Column, most: int = EXCERPT) -> Column:
    asked, excerpt, context = T.trimmed(F.coalesce(question, F.lit(""))), F.left(T.one_line(selection), F.lit(most)), F.left(T.one_line(around), F.lit(most))
    both = F.concat(_quoted(F.lit("关于下面这段内容："), excerpt, context), F.lit("\n\n"), asked)
    return F.when(excerpt == "", asked).when(asked == "", selection_question(selection, around, F.lit("explain"), most)).otherwise(both)


def profile_block(field: Column, direction: Column, goal: Column) -> Column:
    given = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))
    lines = F.concat_ws("\n", F.lit("【用户研究档案】"), given("领域：", field), given("方向：", direction), given("当前目标：", goal), F.lit("调研、选会、写作建议尽量贴合该方向。"))
    return F.when(F.concat_ws("", field, direction, goal) != "", lines).otherwise("")


def glossary_block(terms: Column) -> Column:
    """terms: array<struct<term, translation>>, of which the last 60 count."""
    last = F.slice(terms, F.greatest(F.lit(1), F.size(terms) - 59), F.lit(60))
    lines = F.transform(last, lambda t: F.concat(F.lit("- "), t["term"], F.lit(" => "), t["translation"]))
    return F.when(F.size(terms) > 0, F.concat_ws("\n", F.lit("\n".join(GLOSSARY_HEAD)), F.array_join(lines, "\n"))).otherwise("")


def memory_block(title: Column, todos: Column, facts: Column) -> Column:
    """todos: array<struct<id, text>>, facts: array<string>; eight of each at most."""
    todo_lines = F.array_join(F.transform(F.slice(todos, 1, 8), lambda t: F.concat(F.lit("- ["), t["id"], F.lit("] "), t["text"])), "\n")
    fact_lines = F.array_join(F.transform(F.slice(facts, 1, 8), lambda f: F.concat(F.lit("- "), f)), "\n")
    lines = F.concat_ws(
        "\n", F.lit("【课题记忆 · 跨会话】"), F.when(title != "", F.concat(F.lit("关联论文："), title)), F.when(F.size(todos) > 0, F.concat(F.lit("未完成待办：\n"), todo_lines)), F.when(F.size(facts) > 0, F.concat(F.lit("已记要点：\n"), fact_lines))
    )
    return F.when((F.size(todos) > 0) | (F.size(facts) > 0), lines).otherwise("")


def without_self_talk(text: Column) -> Column:
    """The text before a model begins to talk to itself, if that is a real text already."""
    at = F.regexp_instr(text, F.lit(T.ascii_words(SELF_TALK)))
    head = T.trimmed(F.left(text, F.greatest(F.lit(0), at - 1)))
    real = (F.char_length(head) >= 80) | head.rlike("[\\x{4e00}-\\x{9fff}]{8,}") | head.rlike(r"(?m)^#{1,3}\s")
    return F.when((at > 0) & real, head).otherwise(text)


def graphic_text(text: Column) -> Column:
    """Whether a piece is a formula or the like by its share of signs, not prose."""
    t = F.trim(F.coalesce(text, F.lit("")))
    times = lambda p: F.regexp_count(t, F.lit(p))
    n, letters, digits = F.greatest(F.lit(1), F.char_length(t)), times("[A-Za-z]"), times("[0-9]")
    signs = times("[\\u0370-\\u03ff]") + times(r"[=+\-*/^_{}\\<>|·⋅×÷±∓∑∏∫∇∈∉⊂⊆⊇⊕⊗∀∃∅∞≤≥≠≈≡∝√∂→←↦↔⟨⟩‖∘∗]")
    dense = (signs / n >= 0.16) & (letters / n < 0.6)
    short = (times("[A-Za-z]{3,}") <= 1) & ((signs + digits) / n > 0.4) & (n <= 90)
    return (F.char_length(t) >= 2) & ~t.rlike(r"^\(?\d{1,3}\)?$") & (dense | short)


def trusted_table(kind: Column, detector: Column, confidence: Column, rows: Column, columns: Column) -> Column:
    """Whether a found table may be shown as one. rows: array of arrays of cells."""
    wide = F.greatest(F.coalesce(columns, F.lit(0)), F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0)))
    n = F.size(rows)
    return F.coalesce((kind == "table") & detector.isin(TABLE_DETECTORS) & (confidence >= TABLE_CONFIDENCE) & (n > 0) & (wide > 0) & (n * wide <= TABLE_CELLS), F.lit(False))


def cacheable(text: Column) -> Column:
    return T.trimmed(F.coalesce(text, F.lit(""))) != ""
