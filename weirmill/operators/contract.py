"""Validation of analysis requests and responses kept as JSON text: the first error of each, null where it is valid.

Types are checked as written (a number in quotes is a string); keys beyond the schema, missing ones and repeated ones are
errors. Null and malformed text is ``bad_json``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BODY, MAX_HTML, MAX_URL, MAX_VERSION, MAX_LIST, MAX_LIMITATION, MAX_MESSAGE = 2_097_152, 1_000_000, 8192, 64, 20, 200, 300
COMMON = ["request_id", "navigation_id", "dom_revision", "url", "preprocessing_version", "phase", "capture_mode"]
RESPONSE = ["request_id", "navigation_id", "dom_revision", "phase", "status", "verdict", "score", "threshold", "model", "signals", "limitations", "timing_ms"]
MODEL = ["model_id", "variant", "preprocessing_version", "dictionary_version", "score_semantics"]
SIGNAL = ["code", "org_candidate_id", "domain_relation", "message"]
TIMING = ["preprocess", "extract", "infer", "server_total"]
RELATIONS = ["verified_first_party", "verified_authorized", "unverified_shared_hosting", "unverified", "mismatch", "not_applicable"]
UUID = "^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
PHASES, MODES = ["url_only", "url_content"], ["rendered_dom", "stored_html"]


class _Body:
    """A JSON object in text, read through one variant."""

    def __init__(self, text: Column, value: Column | None = None) -> None:
        self.text, self.value = text, F.try_parse_json(text) if value is None else value

    def kind(self, key: str) -> Column:
        """``string``, ``number``, ``boolean``, ``object``, ``array`` or ``void``; null if the key is missing."""
        k = F.schema_of_variant(F.try_variant_get(self.value, f"$.{key}", "variant"))
        return F.when(k.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "number").when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").otherwise(F.lower(k))

    def string(self, key: str) -> Column:
        return F.when(self.kind(key) == "string", F.try_variant_get(self.value, f"$.{key}", "string"))

    def number(self, key: str) -> Column:
        return F.when(self.kind(key) == "number", F.try_variant_get(self.value, f"$.{key}", "double"))

    def keys(self) -> Column:
        return F.json_object_keys(self.text)

    def bad(self) -> Column:
        return self.value.isNull() | self.keys().isNull()

    def unknown(self, known: list[str]) -> Column:
        return F.size(F.array_except(self.keys(), F.array(*map(F.lit, known)))) > 0

    def missing(self, known: list[str]) -> Column:
        return F.size(F.array_except(F.array(*map(F.lit, known)), self.keys())) > 0

    def part(self, key: str) -> Column:
        """The JSON text of one value."""
        return F.get_json_object(self.text, f"$.{key}")


def _parsed(text: Column, check) -> Column:
    """``check`` of the object in ``text``, which is parsed once however often it is looked into."""
    one = F.array(F.struct(text.alias("text"), F.try_parse_json(text).alias("value")))
    return F.element_at(F.transform(one, lambda b: check(_Body(b["text"], b["value"]))), 1)


def _not(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def _whole(n: Column) -> Column:
    return (n >= 0) & (n == F.floor(n))


def request_error(body: Column) -> Column:
    """``body_too_large`` (bytes, before anything is parsed), ``bad_json``, ``unknown_key`` or the first bad field."""
    fits = F.when(F.octet_length(body) <= MAX_BODY, body)
    return F.when(F.octet_length(body) > MAX_BODY, "body_too_large").otherwise(_parsed(fits, _request_error))


def _request_error(b: _Body) -> Column:
    text, html = b.string, b.string("html")
    content = text("phase") == "url_content"
    return (
        F.when(b.bad(), "bad_json")
        .when(b.unknown([*COMMON, "html"]), "unknown_key")
        .when(_not(text("request_id").rlike(UUID)), "request_id")
        .when(_not(text("navigation_id").rlike(UUID)), "navigation_id")
        .when(_not(_whole(b.number("dom_revision"))), "dom_revision")
        .when(_not(text("phase").isin(PHASES)), "phase")
        .when(_not(text("url").rlike("^https?://[^\\s]+$") & (F.length(text("url")) <= MAX_URL)), "url")
        .when(_not(F.length(text("preprocessing_version")).between(1, MAX_VERSION)), "preprocessing_version")
        .when(content & F.coalesce(b.kind("html") == "void", F.lit(True)), "html_missing")
        .when(~content & b.kind("html").isNotNull(), "html_unexpected")
        .when(content & _not(F.length(html) >= 1), "html")
        .when(content & (F.length(html) > MAX_HTML), "html_too_long")
        .when(_not(F.when(content, text("capture_mode").isin(MODES)).otherwise(text("capture_mode") == "url_only")), "capture_mode")
    )


def _strings(text: Column) -> Column:
    return F.from_json(text, "array<string>")


def _signal_bad(text: Column) -> Column:
    s = _Body(text)
    org = s.kind("org_candidate_id").isin("string", "void")
    right = (F.length(s.string("code")) >= 1) & org & s.string("domain_relation").isin(RELATIONS) & (F.length(s.string("message")) <= MAX_MESSAGE)
    return s.bad() | s.unknown(SIGNAL) | s.missing(SIGNAL) | _not(right)


def response_error(body: Column) -> Column:
    """A completed response has a score and a threshold in [0, 1] and the verdict they give; one of insufficient content has
    neither and says it is unable to assess."""
    return _parsed(body, _response_error)


def _response_error(b: _Body) -> Column:
    model, timing = _Body(b.part("model")), _Body(b.part("timing_ms"))
    score, limit = b.number("score"), b.number("threshold")
    done = b.string("status") == "completed"
    filled = reduce(Column.__and__, (F.length(model.string(k)) >= 1 for k in ("model_id", "preprocessing_version", "dictionary_version")))
    model_right = filled & model.string("variant").isin("M0", "M1", "M2", "M3") & (model.string("score_semantics") == "uncalibrated_model_score")
    timing_right = reduce(Column.__and__, (timing.number(k) >= 0 for k in TIMING))
    notes = F.from_json(b.part("limitations"), "array<variant>")
    note_bad = F.exists(notes, lambda v: _not((F.schema_of_variant(v) == "STRING") & (F.length(F.try_variant_get(v, "$", "string")) <= MAX_LIMITATION)))
    right = F.when(score >= limit, "warning").otherwise("no_indication")
    return (
        F.when(b.bad(), "bad_json")
        .when(b.unknown(RESPONSE), "unknown_key")
        .when(b.missing(RESPONSE), "missing_key")
        .when(_not(b.string("request_id").rlike(UUID)), "request_id")
        .when(_not(b.string("navigation_id").rlike(UUID)), "navigation_id")
        .when(_not(_whole(b.number("dom_revision"))), "dom_revision")
        .when(_not(b.string("phase").isin(PHASES)), "phase")
        .when(_not(b.string("status").isin("completed", "insufficient_content")), "status")
        .when(done & _not(score.between(0, 1)), "score")
        .when(done & _not(limit.between(0, 1)), "threshold")
        .when(done & _not(b.string("verdict") == right), "verdict")
        .when(~done & (b.kind("score") != "void"), "score")
        .when(~done & (b.kind("threshold") != "void"), "threshold")
        .when(~done & _not(b.string("verdict") == "unable_to_assess"), "verdict")
        .when(_not(b.kind("model") == "object") | model.unknown(MODEL) | _not(model_right), "model")
        .when(_not(b.kind("signals") == "array"), "signals")
        .when((F.size(_strings(b.part("signals"))) > MAX_LIST) | F.exists(_strings(b.part("signals")), _signal_bad), "signals")
        .when(_not(b.kind("limitations") == "array") | (F.size(notes) > MAX_LIST) | note_bad, "limitations")
        .when(_not(b.kind("timing_ms") == "object") | timing.unknown(TIMING) | _not(timing_right), "timing_ms")
    )


def status_code(error: Column, version_known: Column | None = None, refused: dict[int, Column] | None = None) -> Column:
    """The HTTP status of a request: what the transport refused first (401, 403, 415, 429, 503 by the conditions given), then
    413 for the body's size, 422 for its content, 409 for a version that is not served, 504 last, else 200."""
    got = F.lit(None).cast("int")
    refused = refused or {}
    late = refused.get(504)
    for code, when in sorted(refused.items()):
        if code != 504:
            got = F.coalesce(got, F.when(when, F.lit(code)))
    got = F.coalesce(got, F.when(error == "body_too_large", 413).when(error.isNotNull(), 422))
    if version_known is not None:
        got = F.coalesce(got, F.when(_not(version_known), 409))
    if late is not None:
        got = F.coalesce(got, F.when(late, 504))
    return F.coalesce(got, F.lit(200))


def verdict(score: Column, threshold: Column) -> Column:
    """Three values: a missing score or threshold is never read as no indication."""
    return F.when(score.isNull() | threshold.isNull(), "unable_to_assess").when(score >= threshold, "warning").otherwise("no_indication")


# The message of each signal, which holds nothing of the page.
MESSAGES = {
    "sensitive_form_detected": "Quan sát thấy trường yêu cầu mật khẩu.", "foreign_destination": "Biểu mẫu gửi dữ liệu tới máy chủ khác.",
    "request_phrase": "Nội dung yêu cầu thông tin đăng nhập hoặc mã xác thực.", "name_on_other_host": "Tên tổ chức xuất hiện trên máy chủ chưa xác minh.",
}


def message(code: Column) -> Column:
    """The static message of a signal code, null for a code that has none."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in MESSAGES.items() for x in kv)), code)


#: What a diagnostic log may hold: nothing of the body and no address.
DIAGNOSTIC = ["request_id", "error", "status_code", "preprocessing_version", "duration_ms"]


def assert_blind(columns: list[str], forbidden: set[str]) -> None:
    """Raise if a view for annotators or features holds a forbidden column."""
    leaked = sorted(set(columns) & forbidden)
    if leaked:
        raise ValueError(f"forbidden columns: {', '.join(leaked)}")
