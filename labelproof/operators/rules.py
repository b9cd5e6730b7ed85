"""Declarative label checks applied as Spark Columns.

A rule is data (see ``plans.rule_catalog``): a gate, an input path, an assertion and the
texts to report. Each rule becomes one array-of-struct Column over the evidence row, so a
whole rule set is a single narrow projection followed by an explode: no shuffle, no UDF.
Rules that are equal in several variants share one expression behind a variant test."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelproof.functions import codes as C
from labelproof.functions import refdata as R
from labelproof.functions import strings as S

RESULT_FIELDS = [
    "id", "rule_id", "rule_set", "title", "severity", "category", "status", "message", "expected", "actual",
    "evidence", "input_path", "input_value",
]


def null() -> Column:
    return F.lit(None).cast("string")


# -- typed values -----------------------------------------------------------------


@dataclass
class Value:
    """A Column with its type, so emptiness and text form are chosen when the plan is built."""

    col: Column
    type: T.DataType

    def get(self, name: str) -> Value:
        if isinstance(self.type, T.StructType) and name in self.type.names:
            return Value(self.col[name], self.type[name].dataType)
        return MISSING()

    @property
    def is_list(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    def empty(self) -> Column:
        if isinstance(self.type, T.NullType):
            return F.lit(True)
        if isinstance(self.type, T.StringType):
            return S.is_blank(self.col)
        if self.is_list:
            return F.coalesce(F.size(self.col) == 0, F.lit(True))
        return self.col.isNull()

    def text(self) -> Column:
        """Scalar text; lists joined with a comma; null stays null."""
        if isinstance(self.type, T.StringType):
            return self.col
        if isinstance(self.type, (T.DoubleType, T.FloatType)):
            return S.number_text(self.col)
        if self.is_list and isinstance(self.type.elementType, T.StringType):
            return F.array_join(self.col, ",")
        if isinstance(self.type, (T.ArrayType, T.StructType)):
            return F.to_json(self.col)
        return self.col.cast("string")

    def json(self) -> Column:
        """Form shown in reports: text as is, everything else as JSON."""
        if isinstance(self.type, (T.ArrayType, T.StructType)):
            return F.to_json(self.col)
        return self.text()


def MISSING() -> Value:
    return Value(null(), T.NullType())


class Scope:
    """Resolves rule paths against the evidence columns and the current list item."""

    def __init__(self, schema: T.StructType, item: Value | None = None):
        self.schema = schema
        self.item = item

    def with_item(self, item: Value) -> Scope:
        return Scope(self.schema, item)

    def at(self, path: str | None) -> Value:
        if not path:
            return MISSING()
        if path == "item":
            return self.item or MISSING()
        if path.startswith("item."):
            value, rest = self.item or MISSING(), path[5:]
        else:
            rest = path.removeprefix("$context.")
            head, _, rest = rest.partition(".")
            if head not in self.schema.names:
                return MISSING()
            value = Value(F.col(head), self.schema[head].dataType)
        for part in filter(None, rest.split(".")):
            value = value.get(part)
        return value


# -- assertions -------------------------------------------------------------------


@dataclass
class Outcome:
    ok: Column
    expected: Column | None = None
    actual: Column | None = None  # as shown in the result row
    said: Column | None = None  # as shown inside message texts
    message: Column | None = None
    evidence: Column | None = None
    status: Column | None = None


CHECKS: dict[str, Callable] = {}


def register_check(name: str):
    """Adds a named check: ``fn(value, scope, args) -> Outcome`` (or a boolean Column)."""

    def add(fn):
        CHECKS[name] = fn
        return fn

    return add


def normalized(col: Column, steps: list[str] | None) -> Column:
    out = F.coalesce(col, F.lit(""))
    for step in steps or []:
        if step == "stripSpaces":
            out = S.drop_white_space(out)
        elif step == "upper":
            out = F.upper(out)
        elif step == "trim":
            out = S.trim(out)
        elif step == "digitsOnly":
            out = F.regexp_replace(out, r"\D+", "")
    return out


def js_text(v) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    return "undefined" if v is None else str(v)


# Digit formats and the two-digit parts each must keep in range.
DATE_FORMATS = {
    "YYMMDDHHMMSS": (12, [(2, "month"), (4, "day"), (6, "hour"), (8, "minute"), (10, "second")]),
    "YYYYMMDD": (8, [(4, "month"), (6, "day")]),
    "YYYYMMDDHHMM": (12, [(4, "month"), (6, "day"), (8, "hour"), (10, "minute")]),
}
PART_RANGES = {"month": (1, 12), "day": (1, 31), "hour": (0, 23), "minute": (0, 59), "second": (0, 59)}


def date_format(text: Column, fmt: str) -> Outcome:
    if fmt not in DATE_FORMATS:
        return Outcome(F.lit(False), message=F.lit(f"Unknown date format {fmt}."))
    n, parts = DATE_FORMATS[fmt]
    shaped = text.rlike(rf"^\d{{{n}}}\z")
    bad = F.when(~shaped, F.lit(f"{fmt} ({n} digits, no spaces)"))
    for offset, kind in parts:
        lo, hi = PART_RANGES[kind]
        part = F.substring(text, offset + 1, 2).try_cast("int")
        bad = bad.when(~part.between(lo, hi), F.lit(f"{fmt} with a valid calendar {kind}"))
    bad = bad.otherwise(null())
    return Outcome(
        bad.isNull(), expected=bad,
        actual=F.coalesce(S.blank_to_null(text), F.when(shaped, text).otherwise("missing")),
    )


def evaluate(check: dict | None, value: Value, scope: Scope) -> Outcome:
    """One assertion node -> its outcome as Columns."""
    if not check:
        return Outcome(F.lit(True))
    if isinstance(check.get("all"), list):
        return _all([evaluate(c, value, scope) for c in check["all"]], value)
    if isinstance(check.get("any"), list):
        return _any([evaluate(c, value, scope) for c in check["any"]], value)

    op, steps, want = check.get("op"), check.get("normalize"), check.get("value")
    raw = value.text()
    text = normalized(raw, steps)
    or_missing = F.coalesce(S.blank_to_null(text), F.lit("missing"))
    empty = value.empty()

    if op in ("present", "absent"):
        hollow = "missing" if op == "present" else "absent"
        ok = ~empty if op == "present" else empty
        return Outcome(
            ok, F.lit(f"value {op}"), F.when(empty, hollow).otherwise(value.json()),
            F.when(empty, hollow).otherwise(raw),
        )
    if op in ("notEmpty", "empty"):
        ok = ~empty if op == "notEmpty" else empty
        shown = (
            F.concat(F.coalesce(F.size(value.col), F.lit(0)).cast("string"), F.lit(" entries"))
            if value.is_list else value.json()
        )
        return Outcome(ok, F.lit("one or more entries" if op == "notEmpty" else "no entries"), shown)
    if op in ("matches", "notMatches"):
        hit = S.test(text, str(want), check.get("flags", ""))
        says = "matches" if op == "matches" else "does not match"
        return Outcome(hit if op == "matches" else ~hit, F.lit(f"{says} {want}"), or_missing)
    if op in ("equals", "notEquals"):
        right = _operand(want, steps, scope)
        left = text if steps else F.coalesce(raw, F.lit("undefined"))
        if op == "equals":
            return Outcome(left == right, right, or_missing)
        return Outcome(left != right, F.concat(F.lit("not "), right), text)
    if op == "equalsPath":
        other = scope.at(check["path"])
        norm = normalized(other.text(), steps)
        return Outcome(
            ~other.empty() & (text == norm),
            F.concat(F.lit(f"{check['path']} = "), F.when(other.empty(), "missing").otherwise(norm)),
            or_missing,
        )
    if op in ("in", "notIn"):
        listed = want if isinstance(want, list) else []
        items = [normalized(F.lit(str(v)), steps) for v in listed]
        hit = text.isin(*items) if items else F.lit(False)
        shown = ", ".join(str(v) for v in listed)
        if op == "in":
            return Outcome(hit, F.lit(f"one of {shown}"), or_missing)
        return Outcome(~hit, F.lit(f"none of {shown}"), text)
    if op == "lengthIn":
        lengths = want if isinstance(want, list) else [want]
        return Outcome(
            F.length(text).isin(*lengths), F.lit("length " + " or ".join(str(v) for v in lengths)),
            F.concat(F.lit("length "), F.length(text).cast("string"), F.lit(" ("), or_missing, F.lit(")")),
        )
    if op == "range":
        num, lo, hi = S.trim(text).try_cast("double"), check.get("min"), check.get("max")
        ok = num.isNotNull() & ~F.isnan(num) & (F.abs(num) < float("inf"))
        ok = ok & (num >= lo) if lo is not None else ok
        ok = ok & (num <= hi) if hi is not None else ok
        shown = f"number between {'-' if lo is None else lo} and {'-' if hi is None else hi}"
        return Outcome(F.coalesce(ok, F.lit(False)), F.lit(shown), or_missing)
    if op == "ltePath":
        other = scope.at(check["path"])
        skip = empty | other.empty()
        left, right = (
            F.coalesce(F.regexp_replace(c, r"\D", "").try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
            for c in (F.coalesce(raw, F.lit("")), F.coalesce(other.text(), F.lit("")))
        )
        return Outcome(
            skip | (left <= right),
            F.when(skip, F.lit(f"<= {check['path']}")).otherwise(F.concat(F.lit("<= "), other.text())), text,
        )
    if op == "uppercase":
        return Outcome(text == F.upper(text), F.lit("fully capitalised"), or_missing)
    if op == "dateFormat":
        return date_format(F.coalesce(raw, F.lit("")), str(want))
    if op == "fn":
        fn = CHECKS.get(check.get("name"))
        if fn is None:
            return Outcome(
                F.lit(False), actual=text, message=F.lit(f"Rule function {check.get('name')} is not registered.")
            )
        out = fn(value, scope, check.get("args") or {})
        return out if isinstance(out, Outcome) else Outcome(F.coalesce(out, F.lit(False)), actual=text)
    return Outcome(F.lit(False), actual=text, message=F.lit(f"Unknown assert op {op}."))


def _operand(want, steps, scope: Scope) -> Column:
    if isinstance(want, str) and want.startswith(("$context.", "item.")):
        right = scope.at(want).text()
        return normalized(right, steps) if steps else F.coalesce(right, F.lit("undefined"))
    return normalized(F.lit(js_text(want)), steps)


PARTS = ["expected", "actual", "said", "message", "evidence", "status"]


def _pick(cases: list[tuple[Column, Outcome]], last: Outcome | None, part: str) -> Column | None:
    outs = [getattr(o, part) for _, o in cases] + [getattr(last, part) if last else None]
    if all(o is None for o in outs):
        return None
    expr = None
    for (cond, _), out in zip(cases, outs):
        out = null() if out is None else out
        expr = F.when(cond, out) if expr is None else expr.when(cond, out)
    return expr.otherwise(outs[-1] if outs[-1] is not None else null())


def _all(outs: list[Outcome], value: Value) -> Outcome:
    ok = outs[0].ok
    for o in outs[1:]:
        ok = ok & o.ok
    passed = Outcome(F.lit(True), actual=value.json(), said=value.text())
    cases = [(~o.ok, o) for o in outs]
    return Outcome(ok, **{p: _pick(cases, passed, p) for p in PARTS})


def _any(outs: list[Outcome], value: Value) -> Outcome:
    if not outs:
        return Outcome(F.lit(False), actual=value.json())
    ok = outs[0].ok
    for o in outs[1:]:
        ok = ok | o.ok
    return Outcome(ok, **{p: _pick([(o.ok, o) for o in outs], outs[0], p) for p in PARTS})


def gate(when: dict | None, scope: Scope) -> Column:
    """Applicability test of a rule or of a list item."""
    if not when:
        return F.lit(True)
    for key, fold in (("all", lambda a, b: a & b), ("any", lambda a, b: a | b)):
        if isinstance(when.get(key), list):
            out = None
            for w in when[key]:
                g = gate(w, scope)
                out = g if out is None else fold(out, g)
            return out if out is not None else F.lit(key == "all")
    return evaluate(when, scope.at(when.get("path")), scope).ok


# -- named checks -------------------------------------------------------------------

MIN_LINEAR_DPI = 200


@register_check("pageSizeWithin")
def page_size_within(page: Value, scope: Scope, args: dict) -> Outcome:
    w, h = page.get("widthMm").col.cast("double"), page.get("heightMm").col.cast("double")
    known = F.coalesce((w != 0) & (h != 0), F.lit(False))
    tolerance, sizes = args.get("toleranceMm", 5), args.get("sizesMm", [])
    fits = F.lit(False)
    for a, b in sizes:
        for x, y in ((a, b), (b, a)):
            fits = fits | ((F.abs(w - x) <= tolerance) & (F.abs(h - y) <= tolerance))
    shown = " or ".join(f"{a}mm x {b}mm" for a, b in sizes) + f" (within {tolerance}mm, either orientation)"
    return Outcome(
        known & F.coalesce(fits, F.lit(False)),
        expected=F.when(known, F.lit(shown)),
        actual=F.when(known, F.format_string("%.1fmm x %.1fmm", w, h)).otherwise(page.json()),
        message=F.when(~known, F.lit("Physical dimensions could not be determined from this file.")),
        status=F.when(~known, F.lit("manual_review")),
    )


@register_check("requiredDecode")
def required_decode(value: Value, scope: Scope, args: dict) -> Outcome:
    ok = F.coalesce(value.col, F.lit(False))
    name = args.get("label") or "The required barcode"
    visible = scope.at(args.get("visiblePath"))
    seen = F.coalesce(visible.col.cast("boolean"), F.lit(False))
    page = scope.at("page")
    dpi = page.get("estimatedDpi").col
    blurred = F.coalesce(page.get("isRasterImage").col.cast("boolean") & (dpi > 0) & (dpi < MIN_LINEAR_DPI), F.lit(False))
    why = F.when(
        seen, F.lit(f"{name} appears visible on the label, but it was not decoded by the scanner pipeline.")
    ).otherwise(F.lit(f"{name} was not decoded from the uploaded file."))
    low = F.when(
        blurred,
        F.concat(
            F.lit("The uploaded image is roughly "), dpi.cast("string"), F.lit(" DPI ("),
            page.get("pixelWidth").text(), F.lit("x"), page.get("pixelHeight").text(),
            F.lit("px). At this resolution the narrow bars and spaces of linear barcodes are usually destroyed and "
                  "cannot be decoded. Upload the original PDF, or export the label image at 300 DPI or higher."),
        ),
    )
    return Outcome(ok, message=F.when(~ok, F.concat_ws(" ", why, low)))


@register_check("inPathList")
def in_path_list(value: Value, scope: Scope, args: dict) -> Outcome:
    other, steps, path = scope.at(args.get("path")), args.get("normalize"), args.get("path")
    source = other.col if other.is_list else F.array(other.text())
    if isinstance(other.type, T.NullType):
        source = F.array(null())
    listed = F.filter(F.transform(source, lambda v: normalized(v.cast("string"), steps)), lambda v: v != "")
    listed = F.coalesce(listed, F.array().cast("array<string>"))
    none = F.size(listed) == 0
    needle = normalized(value.text(), steps)
    return Outcome(
        ~none & F.array_contains(listed, needle),
        expected=F.when(none, F.lit(f"a matching value in {path}")).otherwise(F.array_join(listed, ", ")),
        actual=F.when(none, F.lit("no comparison values available")).otherwise(
            F.coalesce(S.blank_to_null(needle), F.lit("missing"))),
        message=F.when(none, F.lit(f"No values were available at {path} to compare against.")),
        status=F.when(none, F.lit("manual_review")),
    )


@register_check("eparcelCheckDigit")
def eparcel_check_digit(article: Value, scope: Scope, args: dict) -> Outcome:
    body, given = article.get("withoutCheckDigit").col, article.get("checkDigit").col
    known = F.coalesce(body != "", F.lit(False))
    want = article.get("expectedCheckDigit").col
    ok = F.coalesce(want == given, F.lit(False))
    return Outcome(
        ok, expected=want, actual=F.coalesce(given, article.json()),
        evidence=F.when(known, C.article_check_steps(body)),
        message=F.when(~known, F.lit("Article body unavailable for check digit calculation."))
        .when(ok, F.concat(F.lit("Check digit is valid: "), given, F.lit(".")))
        .otherwise(F.concat(F.lit("Check digit mismatch. Expected "), F.coalesce(want, F.lit("null")),
                            F.lit(", got "), given, F.lit("."))),
        status=F.when(~known, F.lit("manual_review")),
    )


@register_check("serviceProductCompatible")
def service_product_compatible(article: Value, scope: Scope, args: dict) -> Outcome:
    service, product = article.get("serviceCode").col, article.get("productCode").col
    name, allowed = R.service_name(service), R.service_products(service)
    ok = name.isNull() | F.coalesce(F.array_contains(allowed, product), F.lit(False))
    title = F.concat(F.lit("Service "), service, F.lit(" ("), name, F.lit(")"))
    return Outcome(
        ok, expected=F.array_join(allowed, ", "), actual=F.when(name.isNotNull(), product).otherwise(article.json()),
        message=F.when(
            name.isNull(),
            F.concat(F.lit("Service code "), F.coalesce(service, F.lit("unknown")),
                     F.lit(" is not recognised; the known-service rule reports that separately.")),
        ).otherwise(
            F.concat(title, F.when(ok, " supports product ").otherwise(" does not support product "), product, F.lit("."))
        ),
    )


@register_check("linearDmAgreement")
def linear_dm_agreement(derived: Value, scope: Scope, args: dict) -> Outcome:
    a = F.array_distinct(derived.get("linearArticleIds").col)
    b = F.array_distinct(derived.get("dmArticleIds").col)
    ok = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    shown = [F.coalesce(S.blank_to_null(F.array_join(x, ", ")), F.lit("none")) for x in (a, b)]
    return Outcome(
        ok, F.lit("identical article numbers in both symbols"),
        F.concat(F.lit("linear: "), shown[0], F.lit(" | datamatrix: "), shown[1]),
        message=F.when(ok, "The linear barcode and DataMatrix encode the same article number(s).").otherwise(
            "The linear barcode and DataMatrix do not encode the same article number(s)."),
    )


@register_check("routeProductMatch")
def route_product_match(route: Value, scope: Scope, args: dict) -> Outcome:
    product = S.blank_to_null(scope.at("derived.primaryProductCode").col)
    want, given = R.freight_label_code(product), route.get("labelCode").col
    ok = want.isNull() | F.coalesce(given == want, F.lit(False))
    shown = F.coalesce(given, F.lit("missing"))
    return Outcome(
        ok, expected=want, actual=F.when(want.isNotNull(), shown).otherwise(route.json()),
        message=F.when(
            want.isNull(),
            F.concat(F.lit("Product "), F.coalesce(product, F.lit("unknown")),
                     F.lit(" has no routing label code mapping to assert.")),
        ).otherwise(
            F.concat(F.lit("Routing label code "), shown, F.when(ok, " matches product ")
                     .otherwise(" does not match product "), product, F.lit("."))
        ),
    )


# QR fields that must not be blank, with the names shown to reviewers.
QR_MANDATORY = [
    ("receiverSuburb", "Receiver suburb"),
    ("receiverPostcode", "Receiver postcode"),
    ("connoteNumber", "Consignment number"),
    ("freightItemNumber", "Freight item number"),
    ("productCode", "Product code"),
    ("consignmentQuantity", "Consignment quantity"),
    ("consignmentWeight", "Consignment weight"),
    ("despatchDate", "Despatch date"),
    ("receiverName1", "Receiver name"),
    ("unitType", "Unit type"),
    ("destinationDepot", "Destination depot"),
    ("receiverAddress1", "Receiver address line 1"),
    ("dangerousGoodsIndicator", "Dangerous goods indicator"),
    ("movementTypeIndicator", "Movement type indicator"),
]


@register_check("qrMandatoryFields")
def qr_mandatory_fields(fields: Value, scope: Scope, args: dict) -> Outcome:
    blank = F.concat_ws(", ", *[F.when(fields.get(k).empty(), F.lit(label)) for k, label in QR_MANDATORY])
    ok = blank == ""
    return Outcome(
        ok, F.lit("all mandatory QR fields populated"),
        F.when(ok, "all populated").otherwise(F.concat(F.lit("missing: "), blank)),
        message=F.when(ok, "Mandatory QR fields are populated.").otherwise(
            F.concat(F.lit("QR mandatory fields missing: "), blank, F.lit("."))),
    )


@register_check("startrackUnitPermitted")
def startrack_unit_permitted(fields: Value, scope: Scope, args: dict) -> Outcome:
    unit, product = fields.get("unitType").col, S.blank_to_null(fields.get("productCode").col)
    allowed = R.unit_products(unit)
    ok = F.coalesce(allowed.isNotNull() & (product.isNull() | F.array_contains(allowed, product)), F.lit(False))
    shown_unit, shown_product = F.coalesce(S.blank_to_null(unit), F.lit("blank")), F.coalesce(product, F.lit("unknown"))
    return Outcome(
        ok,
        F.when(allowed.isNotNull(), F.concat(F.lit("unit "), unit, F.lit(" permitted for: "), F.array_join(allowed, ", ")))
        .otherwise("a known Appendix A unit type"),
        F.concat(shown_unit, F.lit(" for product "), shown_product),
        message=F.when(
            ok, F.concat(F.lit("Unit type "), unit, F.lit(" is permitted"),
                         F.when(product.isNotNull(), F.concat(F.lit(" for "), product)).otherwise(""), F.lit("."))
        ).otherwise(
            F.concat(F.lit("Unit type "), shown_unit, F.lit(" could not be confirmed against product "),
                     shown_product, F.lit("."))
        ),
    )


# -- rule -> Column -------------------------------------------------------------------
#
# A rule yields compact verdicts (rule number, status, values). What is the same for every
# label - id, title, severity, texts - is added after the explode from the rule dimension, so
# expressions stay small and wide strings are never built in arrays. Verdicts come in groups:
# one of the rules without a list, one for each item of a list.

VERDICT = T.StructType([T.StructField(n, T.StringType()) for n in (
    "mark", "status", "expected", "actual", "said", "message", "evidence", "value", "kind")])
#: Without texts a verdict is one string, its rule's mark and the status: list items are judged by interpreted code, where a
#: struct for each rule costs more than the rule.
BRIEF = T.StringType()
MARK = 6


def mark(k: int) -> str:
    return f"{k:0{MARK}d}"


#: A result row that is not a rule's, all text.
CODED = T.StructType([T.StructField(n, T.StringType()) for n in RESULT_FIELDS])


@dataclass
class Status:
    """``pass`` where ok holds (never, without one), else the check's own status or the rule's."""

    failed: str
    ok: Column | None = None
    own: Column | None = None

    def after(self, prefix: str) -> Column:
        """The status behind a prefix; constant unless the check has a status of its own."""
        failed = F.lit(prefix + self.failed)
        if self.own is not None:
            failed = F.coalesce(F.concat(F.lit(prefix), self.own) if prefix else self.own, failed)
        return failed if self.ok is None else F.when(self.ok, prefix + "pass").otherwise(failed)


class Compiler:
    """Turns rules into verdict Columns for one evidence schema."""

    def __init__(self, schema: T.StructType, detail: bool):
        self.scope, self.detail = Scope(schema), detail
        self.null = null()
        self.type = VERDICT if detail else BRIEF

    def verdict(self, k: int, rule: dict, s: Scope, status: Status, out: Outcome, value: Value, kind=None) -> Column:
        if not self.detail:
            return status.after(mark(k))
        cols = [F.lit(mark(k)).alias("mark"), status.after("").alias("status")]
        shown = [(p, s.at(p)) for p in rule.get("evidence") or []]
        evidence = F.concat_ws(
            "\n", *[F.when(~v.empty(), F.concat(F.lit(f"{p}: "), v.json())) for p, v in shown]
        ) if shown else self.null
        if out.evidence is not None:
            evidence = F.coalesce(S.blank_to_null(out.evidence), evidence) if shown else out.evidence
        actual = value.json() if out.actual is None else out.actual
        said = out.said if out.said is not None else (
            value.text() if out.actual is None and isinstance(value.type, (T.ArrayType, T.StructType)) else self.null)
        fields = {
            "expected": out.expected, "actual": actual, "said": said, "message": out.message, "evidence": evidence,
            "value": value.json(), "kind": None if kind is None else F.lit(kind),
        }
        return F.struct(*cols, *[(self.null if c is None else c).alias(n) for n, c in fields.items()])

    def judged(self, k: int, rule: dict, s: Scope, value: Value) -> Column:
        """Verdict for one input; null when the rule is silent about a missing value."""
        check = rule.get("assert")
        out = evaluate(check, value, s)
        verdict = self.verdict(k, rule, s, Status(rule.get("failStatus") or "fail", out.ok, out.status), out, value)
        if check and check.get("op") in ("present", "absent", "notEmpty", "empty"):
            return verdict
        policy = rule.get("onMissing") or "fail"
        if policy == "skip":
            return F.when(~value.empty(), verdict)
        gone = Outcome(F.lit(False), F.lit("value present"), F.lit("missing"))
        status = Status((rule.get("failStatus") or "fail") if policy == "fail" else policy)
        return F.when(value.empty(), self.verdict(k, rule, s, status, gone, value, "missing")).otherwise(verdict)

    def single(self, k: int, rule: dict, variants) -> list[Column]:
        """Rules without a list: one verdict or null."""
        value = self.scope.at(rule["input"]) if rule.get("input") else MISSING()
        return self.gated(k, rule, variants, self.judged(k, rule, self.scope, value))

    def gated(self, k: int, rule: dict, variants, verdict: Column) -> list[Column]:
        applies = variants
        if rule.get("when"):
            g = gate(rule["when"], self.scope)
            if rule.get("reportWhenSkipped"):
                why = Outcome(F.lit(False), actual=F.lit(""))
                skipped = self.verdict(k, rule, self.scope, Status("not_applicable"), why, MISSING(), "skipped")
                verdict = F.when(g, verdict).otherwise(skipped)
            else:
                applies = g if applies is None else applies & g
        return [verdict if applies is None else F.when(applies, verdict)]

    def listed(self, path: str, rules: list[tuple[int, dict, Column | None]]) -> tuple[list[Column], Column | None]:
        """All rules over one list share a single pass over its items: verdicts about the list itself, groups of its items."""
        items = self.scope.at(path)
        out = []
        for k, rule, variants in rules:
            if (rule.get("onEmpty") or "skip") != "skip":
                none = Outcome(F.lit(False), F.lit(f"{path} populated"), F.lit("none decoded"))
                row = self.verdict(k, rule, self.scope, Status(rule["onEmpty"]), none, MISSING())
                out += self.gated(k, rule, variants, F.when(items.empty(), row))
            elif rule.get("when") and rule.get("reportWhenSkipped"):
                out += self.gated(k, rule, variants, F.lit(None).cast(self.type))
        if not items.is_list:
            return out, None
        many = F.size(items.col) > 1

        def one(x: Column, i: Column) -> Column:
            s = self.scope.with_item(Value(x, items.type.elementType))
            rows = []
            for k, rule, variants in rules:
                value = s.at(rule["input"]) if rule.get("input") else s.item
                conds = [variants, gate(rule["itemWhen"], s) if rule.get("itemWhen") else None,
                         gate(rule["when"], self.scope) if rule.get("when") else None]
                row = self.judged(k, rule, s, value)
                conds = [c for c in conds if c is not None]
                if conds:
                    test = conds[0]
                    for c in conds[1:]:
                        test = test & c
                    row = F.when(test, row)
                rows.append(row)
            return self.group(rows, F.when(many, i))

        return out, F.coalesce(F.transform(items.col, one), F.array().cast(T.ArrayType(self.group_type())))

    # what is not a rule's verdict has a place beside the verdicts, see `apply_rules`

    def group_type(self) -> T.StructType:
        return T.StructType([T.StructField("i", T.IntegerType()), T.StructField("verdicts", T.ArrayType(self.type)), T.StructField("coded", T.ArrayType(CODED))])

    def group(self, verdicts: list[Column], index: Column | None = None, coded: Column | None = None) -> Column:
        none = lambda t: F.array().cast(T.ArrayType(t))
        return F.struct(
            (F.lit(None).cast("int") if index is None else index).alias("i"),
            (F.array(*verdicts) if verdicts else none(self.type)).alias("verdicts"),
            (none(CODED) if coded is None else coded).alias("coded"))


# -- rule sets ------------------------------------------------------------------------


def resolve_constants(node, constants: dict):
    """``{{name}}`` and ``$constants.name`` replaced by the rule set's constants; unknown tokens stay."""
    if isinstance(node, str):
        if node.startswith("$constants."):
            return constants.get(node.removeprefix("$constants."))

        def sub(m):
            v = constants.get(m.group(1))
            if v is None:
                return m.group(0)
            return "|".join(map(str, v)) if isinstance(v, list) else str(v)

        return re.sub(r"\{\{(\w+)\}\}", sub, node)
    if isinstance(node, list):
        return [resolve_constants(v, constants) for v in node]
    if isinstance(node, dict):
        return {k: resolve_constants(v, constants) for k, v in node.items()}
    return node


def arrange(rule_sets: dict[str, dict]) -> list[tuple[dict, list[str]]]:
    """Rule sets by variant -> (rule, variants it applies to), each set's own order preserved."""
    order: list[str] = []
    forms: dict[str, dict[str, tuple[dict, list[str]]]] = {}
    for variant, rs in rule_sets.items():
        for rule in rs["rules"]:
            if rule.get("disabled"):
                continue
            rule = resolve_constants(rule, rs.get("constants") or {})
            if rule["id"] not in forms:
                forms[rule["id"]] = {}
                order.append(rule["id"])
            key = json.dumps(rule, sort_keys=True)
            forms[rule["id"]].setdefault(key, (rule, []))[1].append(variant)
    return [form for rid in order for form in forms[rid].values()]


MESSAGE_KEYS = ("pass", "fail", "missing", "skipped")


def number_rules(rule_sets: dict[str, dict]) -> list[tuple[int, dict, list[str]]]:
    return [(k, rule, variants) for k, (rule, variants) in enumerate(arrange(rule_sets))]


def rule_dimension(spark, rule_sets: dict[str, dict]) -> DataFrame:
    """(variant, k) -> everything a result row repeats. Its size is set by the rule files."""
    rows = []
    for k, rule, variants in number_rules(rule_sets):
        title, texts = rule.get("title") or rule["id"], rule.get("messages") or {}
        pieces = {m: re.split(r"(\{(?:value|expected|actual|path)\})", texts[m]) for m in MESSAGE_KEYS if texts.get(m)}
        pieces.setdefault("pass", [f"{title} requirement met."])
        pieces.setdefault("fail", [f"{title} requirement not met."])
        pieces.setdefault("skipped", [f"{title} does not apply to this label."])
        severity = rule.get("severity") or ("ERROR" if rule.get("obligation") == "mandatory" else "INFO")
        for v in variants:
            rows.append((
                v, k, mark(k), rule["id"], rule_sets[v]["id"], title, severity, rule.get("category") or "general",
                rule.get("input") or rule.get("forEach") or "", rule.get("input") or "",
                [p for p in pieces["pass"] if p], [p for p in pieces["fail"] if p],
                "".join(pieces["missing"]) if "missing" in pieces else None, "".join(pieces["skipped"]),
            ))
    return spark.createDataFrame(
        rows,
        "variant string, k int, mark string, rule_id string, rule_set string, title string, severity string, category string, "
        "input_path string, _path string, _pass array<string>, _fail array<string>, _missing string, _skipped string",
    )


def verdicts(schema: T.StructType, rule_sets: dict[str, dict], detail: bool = True, coded: Column | None = None) -> Column:
    """Groups of verdicts of one evidence row, and one of result rows that are not a rule's."""
    comp = Compiler(schema, detail)
    plain, lists, groups = [], {}, []
    for k, rule, variants in number_rules(rule_sets):
        test = None if len(variants) == len(rule_sets) else F.col("variant").isin(*variants)
        if rule.get("forEach"):
            lists.setdefault(rule["forEach"], []).append((k, rule, test))
        else:
            plain += comp.single(k, rule, test)
    for path, rules in lists.items():
        about, items = comp.listed(path, rules)
        plain += about
        groups += [] if items is None else [items]
    first = [comp.group(plain)] + ([] if coded is None else [comp.group([], coded=coded)])
    return F.concat(F.array(*first), *groups)


def apply_rules(
    evidence: DataFrame, rule_sets: dict[str, dict], detail: bool = True, keep: tuple[str, ...] = ("label_id",),
    coded: Column | None = None,
) -> DataFrame:
    """Every applicable rule on every label: one row per (label, rule, item).

    ``rule_sets`` maps variant -> merged rule set; the evidence row names its variant.
    ``result_seq`` orders a label's rows by rule, then item. ``detail=False`` leaves the
    texts out when only statuses are needed. ``coded``: an array of result rows (`CODED`) of
    the same evidence, which is derived once for both; they come before the rules' rows."""
    dim = rule_dimension(evidence.sparkSession, rule_sets)
    # outer + filter: for a plain explode Spark infers a size test on the whole expression and
    # pushes it down through every step that builds the evidence
    groups = evidence.select(*keep, "variant", verdicts(evidence.schema, rule_sets, detail, coded).alias("_v")).select(
        *keep, "variant", F.explode_outer("_v").alias("_g"))
    if coded is None:
        rows = groups.select(*keep, "variant", F.col("_g.i").alias("i"), F.explode_outer("_g.verdicts").alias("_x")).filter(F.col("_x").isNotNull())
    else:
        rows = groups.select(*keep, "variant", F.col("_g.i").alias("i"), F.posexplode_outer(F.arrays_zip("_g.verdicts", "_g.coded")).alias("_n", "_z"))
        rows = rows.select(*keep, "variant", "i", "_n", F.col("_z.coded").alias("_c"), F.col("_z.verdicts").alias("_x"))
        rows = rows.filter(F.col("_x").isNotNull() | F.col("_c").isNotNull())
    extra = [] if coded is None else ["_n", "_c"]
    x = [F.col(f"_x.{n}") for n in VERDICT.names] if detail else [
        F.left("_x", F.lit(MARK)).alias("mark"), F.substr("_x", F.lit(MARK + 1)).alias("status")]
    rows = rows.select(*keep, "variant", "i", *extra, *x)
    # the rule dimension has one row per rule and variant, whatever the data size
    df = rows.join(F.broadcast(dim), ["variant", "mark"], "inner" if coded is None else "left")
    many = F.col("i")
    cols = {
        "result_seq": F.col("k").cast("bigint") * F.lit(1 << 32) + F.coalesce(many, F.lit(0)),
        "id": F.when(many.isNotNull(), F.concat("rule_id", F.lit("_"), many.cast("string"))).otherwise(F.col("rule_id")),
    }
    order = ["result_seq", "id", "rule_id", "rule_set", "severity", "category", "status"]
    if detail:
        order = ["result_seq", *RESULT_FIELDS]
        cols |= texts()
    cols = {n: cols.get(n, F.col(n)) for n in order}
    if coded is not None:
        is_coded = F.col("_c").isNotNull()
        # a variant without rules has only the coded checks
        df = df.filter(is_coded | F.col("rule_id").isNotNull())
        cols = {n: F.when(is_coded, F.col("_n").cast("bigint") - F.lit(1 << 40) if n == "result_seq" else F.col(f"_c.{n}")).otherwise(c)
                for n, c in cols.items()}
    return df.select(*keep, *[c.alias(n) for n, c in cols.items()])


def texts() -> dict[str, Column]:
    """The texts of a result row from its verdict and its rule's pieces."""
    parts = {
        "{value}": F.col("value"), "{expected}": F.col("expected"),
        "{actual}": F.coalesce("said", "actual"), "{path}": F.col("_path"),
    }

    def piece(p: Column) -> Column:
        case = None
        for token, c in parts.items():
            c = F.coalesce(c, F.lit(""))
            case = F.when(p == token, c) if case is None else case.when(p == token, c)
        return case.otherwise(p)

    filled = F.array_join(F.transform(F.when(F.col("status") == "pass", F.col("_pass")).otherwise(F.col("_fail")), piece), "")
    blank = F.lit("")
    return {
        "message": F.coalesce(
            S.blank_to_null(F.col("message")),
            F.when(F.col("kind") == "missing", F.col("_missing")).when(F.col("kind") == "skipped", F.col("_skipped")),
            filled,
        ),
        "expected": F.coalesce("expected", blank), "actual": F.coalesce("actual", blank),
        "evidence": F.coalesce("evidence", blank), "input_value": F.col("value"),
    }
