"""Column functions that decode barcode strings into typed structs.

Each function takes the raw scan value as a Column and returns a Column, so a
whole scan table decodes in one narrow, shuffle-free projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import refdata as R
from . import strings as S

# Fixed value: AI 01 plus the postal operator's GTIN that opens every article barcode.
GTIN_PREFIX = "0199312650999998"
GS_CHARS = "\x1c\x1d\x1e"
# the symbology identifiers a scan may open with
SYMBOLOGY = r"^(?:\]C1(?:\]d2)?|\]d2)"
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# A letter counts as the last digit of its ASCII code in the article check digit.
LETTER_DIGITS = "".join(str(ord(c))[-1] for c in LETTERS)
ARTICLE_DIGITS = 22
SSCC_DIGITS = 17


def normalize(raw: Column) -> Column:
    """Canonical GS1 text: symbology prefix dropped, separators as ``|``, bracketed AIs unwrapped."""
    c = S.trim(F.coalesce(raw, F.lit("")))
    c = S.without(F.regexp_replace(c, SYMBOLOGY, ""), GS_CHARS, "|")
    for ai in ("00", "01", "91"):
        c = F.replace(c, F.lit(f"({ai})"), F.lit(ai))
    for ai in ("420", "92", "8008"):
        c = F.replace(c, F.lit(f"({ai})"), F.lit(f"|{ai}"))
    c = S.without(c, "\t ")
    return S.without(F.replace(c, F.lit("\r\n"), F.lit("|")), "\n", "|")


def strip(raw: Column) -> Column:
    """Second canonical form: no separators, no white space, upper case."""
    c = F.regexp_replace(F.coalesce(raw, F.lit("")), SYMBOLOGY, "")
    return F.upper(S.drop_white_space(S.without(c, GS_CHARS + "|")))


def bare(stripped: Column) -> Column:
    return S.without(stripped, "()")


def role_value(raw: Column) -> Column:
    """Form used to recognise freight/routing/ATL roles: brackets and blanks removed, upper case."""
    return F.upper(S.drop_white_space(S.without(F.coalesce(raw, F.lit("")), "()")))


# -- check digits -----------------------------------------------------------


def to_digits(body: Column) -> Column:
    return F.translate(F.upper(body), LETTERS, LETTER_DIGITS)


def weighted_sum(padded: str, width: int) -> Column:
    """Sum of digit x (3,1,3,..) from the right over the column named ``padded``, which holds
    digits left-padded with zeros to ``width``. Unrolled, so it runs in generated code."""
    terms = [
        f"{3 if (width - i) % 2 == 0 else 1} * (ascii(substring({padded}, {i}, 1)) - 48)" for i in range(1, width + 1)
    ]
    return F.expr(" + ".join(terms))


def weighted_sum_any(digits: Column) -> Column:
    """The same for digit strings of any length."""
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda ch, i: F.coalesce(ch.try_cast("int"), F.lit(0)) * F.when(i % 2 == 0, 3).otherwise(1),
        ),
        F.lit(0),
        lambda a, b: a + b,
    )


def mod10(total: Column) -> Column:
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def check_digit_any(digits: Column) -> Column:
    """Check digit of a digit string of any length; null when it is not all digits."""
    return F.when(digits.rlike(r"^\d+\z"), mod10(weighted_sum_any(digits)))


def article_check_steps(body: Column) -> Column:
    """Working shown to reviewers: every term, the sum and the digit."""
    digits = to_digits(body)
    terms = F.transform(
        F.filter(F.split(F.reverse(digits), ""), lambda ch: ch != ""),
        lambda ch, i: F.concat(
            ch,
            F.when(i % 2 == 0, "x3=").otherwise("x1="),
            (ch.try_cast("int") * F.when(i % 2 == 0, 3).otherwise(1)).cast("string"),
        ),
    )
    total = weighted_sum_any(digits)
    return F.when(
        digits.rlike(r"^\d+\z"),
        F.concat(
            F.lit("Converted="), digits, F.lit("; "), F.array_join(terms, " + "),
            F.lit("; sum="), total.cast("string"), F.lit("; checkDigit="), mod10(total),
        ),
    ).otherwise(F.concat(F.lit("Input contains invalid characters after alpha substitution: "), digits))


# -- article scans ----------------------------------------------------------

SSCC_20 = r"^00\d{18}\z"
ARTICLE_21 = r"^[A-Z0-9]{3}\d{9}[A-Z0-9]{9}"
ARTICLE_23 = r"^[A-Z0-9]{5}\d{9}[A-Z0-9]{9}"


def clean_article(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def trim_article(cleaned: Column) -> Column:
    """Cleaned candidate cut to its valid 21/23 character prefix when it has one."""
    return S.blank_to_null(
        F.when(cleaned.rlike(ARTICLE_21), F.left(cleaned, F.lit(21)))
        .when(cleaned.rlike(SSCC_20), cleaned)
        .when(cleaned.rlike(ARTICLE_23), F.left(cleaned, F.lit(23)))
        .otherwise(cleaned)
    )


def article_source(norm: Column, compact: Column) -> Column:
    """Where the article identifier sits in a scan: after the GTIN and AI 91, in an AI 91
    segment of its own, or after AI 91 in unseparated data; null when in none of these."""
    behind_gtin = F.substring_index(F.substring(norm, 19, 1 << 30), "|", 1)
    segment = r"(?i)(?:^|\|)91([A-Z0-9]{21,23})(?:\||\z)"
    ai91 = F.locate("91", compact, 15)
    return (
        F.when(norm.startswith(GTIN_PREFIX + "91"), behind_gtin)
        .when(norm.rlike(segment), F.regexp_extract(norm, segment, 1))
        .when(compact.startswith("01") & (ai91 > 0), F.substring(compact, ai91 + 2, F.length(compact)))
    )


def article_reject_reason(candidate: Column) -> Column:
    n = F.length(candidate).cast("string")
    return F.when(
        candidate.rlike(r"^00\d+\z") & (F.length(candidate) != 20),
        F.concat(F.lit("SSCC article IDs must be 20 digits including AI 00. Detected length "), n, F.lit(".")),
    ).otherwise(
        F.concat(
            F.lit("Standard eParcel article IDs must be 21 characters for 3-character MLID or 23 characters "
                  "for 5-character MLID. Detected length "), n, F.lit("."),
        )
    )


def mlid_length(candidate: Column) -> Column:
    """3 or 5 for a plausible standard article, otherwise null."""
    return F.when((F.length(candidate) == 21) & candidate.rlike(ARTICLE_21), 3).when(
        (F.length(candidate) == 23) & candidate.rlike(ARTICLE_23), 5
    )


def with_article(df: DataFrame, candidate: str = "article_candidate") -> DataFrame:
    """Adds the ``article`` struct, null when the candidate's structure is not plausible.

    Staged so that every part is computed once."""
    c, m = F.col(candidate), F.col("_m")
    df = df.withColumn("_m", mlid_length(c))
    df = df.withColumns(
        {
            "_sscc20": c.rlike(SSCC_20),
            "_product": F.when(m.isNotNull(), F.substring(c, m + 10, F.lit(5))),
            "_service": F.when(m.isNotNull(), F.substring(c, m + 15, F.lit(2))),
            "_body": F.when(m.isNotNull(), F.left(c, F.length(c) - 1)),
        }
    )
    df = df.withColumn("_digits", F.lpad(to_digits(F.col("_body")), ARTICLE_DIGITS, "0"))
    product, service = F.col("_product"), F.col("_service")
    struct = F.struct(
        F.when(m.isNotNull(), "eparcel-standard").otherwise("sscc").alias("type"),
        c.alias("articleId"),
        F.when(F.col("_sscc20"), c).alias("sscc"),
        F.left(c, m).alias("mlid"),
        F.substring(c, m + 1, F.lit(7)).alias("consignmentSuffix"),
        F.left(c, m + 7).alias("consignmentId"),
        F.substring(c, m + 8, F.lit(2)).alias("articleCount"),
        product.alias("productCode"),
        R.product_name(product).alias("productDescription"),
        service.alias("serviceCode"),
        R.service_description(service).alias("serviceDescription"),
        F.substring(c, m + 17, F.lit(1)).alias("postagePaidIndicator"),
        F.substring(c, m + 18, F.lit(1)).alias("checkDigit"),
        F.col("_body").alias("withoutCheckDigit"),
        m.alias("mlidLength"),
        F.when(m.isNotNull(), mod10(weighted_sum("_digits", ARTICLE_DIGITS))).alias("expectedCheckDigit"),
    )
    df = df.withColumn("article", F.when(F.col("_sscc20") | m.isNotNull(), struct))
    return df.drop("_m", "_sscc20", "_product", "_service", "_body", "_digits")


# -- SSCC / freight / routing / ATL / QR ------------------------------------


def sscc_digits(stripped: Column) -> Column:
    """The 18 digits behind a leading AI 00, null when there is none."""
    return S.extract(F.replace(stripped, F.lit("(00)"), F.lit("00")), r"^00(\d{18})")


def with_sscc(df: DataFrame) -> DataFrame:
    """Adds the ``sscc`` struct; null when absent, ``valid`` tells the check digit."""
    d = F.col("_sscc18")
    df = df.withColumn("_sscc18", sscc_digits(F.col("_stripped")))
    df = df.withColumn("_body17", F.left(d, F.lit(SSCC_DIGITS)))
    df = df.withColumn("_want", F.when(d.isNotNull(), mod10(weighted_sum("_body17", SSCC_DIGITS))))
    want, given = F.col("_want"), F.right(d, F.lit(1))
    struct = F.struct(
        (want == given).alias("valid"),
        F.col("raw_value").alias("raw"),
        F.lit("00").alias("ai"),
        d.alias("sscc"),
        F.concat(F.lit("00"), d).alias("articleId"),
        F.left(d, F.lit(1)).alias("extensionDigit"),
        F.substring(d, 2, 16).alias("companyPrefixAndSerial"),
        given.alias("checkDigit"),
        want.alias("expectedCheckDigit"),
        F.when(want == given, "Valid SSCC check digit.").otherwise(
            F.concat(F.lit("SSCC check digit mismatch. Expected "), want, F.lit(", got "), given, F.lit("."))
        ).alias("reason"),
    )
    return df.withColumn("sscc", F.when(d.isNotNull(), struct)).drop("_sscc18", "_body17", "_want")


FREIGHT_ITEM = r"^[A-Z0-9]{4}\d{8}[A-Z0-9]{3}\d{5}\z"


def freight(raw: Column, bare: Column, bar_count: Column) -> Column:
    c = bare
    product = F.substring(c, 13, 3)
    return F.when(
        c.rlike(FREIGHT_ITEM),
        F.struct(
            F.lit("startrack-code128-freight").alias("type"),
            raw.alias("raw"),
            c.alias("freightItemId"),
            F.left(c, F.lit(4)).alias("despatchId"),
            F.substring(c, 5, 8).alias("consignmentSequence"),
            F.left(c, F.lit(12)).alias("connoteNumber"),
            product.alias("productCode"),
            R.freight_name(product).alias("productName"),
            R.freight_group(product).alias("productGroup"),
            R.freight_label_code(product).alias("expectedLabelCode"),
            F.substring(c, 16, 5).alias("itemNumber"),
            bar_count.cast("int").alias("barCount"),
        ),
    )


GS1_ROUTE = r"421(036)(\d{4})403([A-Z0-9]{3})"
ROUTE = r"^([A-Z0-9]{3})(\d{4})([A-Z0-9]{2,3})$"


def routing_parts(bare: Column) -> dict[str, Column]:
    c = bare
    gs1 = S.extract(c, GS1_ROUTE, 3)
    plain = S.extract(c, ROUTE, 1)
    return {"gs1": gs1, "label": F.coalesce(gs1, plain)}


def routing(raw: Column, p: dict[str, Column]) -> Column:
    is_gs1 = p["gs1"].isNotNull()
    return F.when(
        p["label"].isin(*R.label_codes()),
        F.struct(
            F.when(is_gs1, "gs1-421-routing").otherwise("startrack-routing").alias("type"),
            raw.alias("raw"),
            F.when(is_gs1, "036").alias("countryCode"),
            p["label"].alias("labelCode"),
            F.when(is_gs1, S.extract(p["compact"], GS1_ROUTE, 2))
            .otherwise(S.extract(p["compact"], ROUTE, 2)).alias("postcode"),
            F.when(is_gs1, "").otherwise(S.extract(p["compact"], ROUTE, 3)).alias("depotOrPort"),
            R.lookup(p["label"], R.label_code_products()).alias("supportedProducts"),
            F.when(is_gs1, "GS1 421 routing barcode for AU Domestic SSCC labels")
            .otherwise("StarTrack routing barcode SSS9999DD/DDD").alias("formatDescription"),
        ),
    )


def routing_reject_reason(p: dict[str, Column]) -> Column:
    return (
        F.when(p["label"].isin(*R.label_codes()), F.lit(None).cast("string"))
        .when(p["gs1"].isNotNull(),
              F.concat(F.lit("Unknown StarTrack GS1 routing label code "), p["gs1"], F.lit(".")))
        .when(p["label"].isNotNull(),
              F.concat(F.lit("Unknown StarTrack routing label code "), p["label"], F.lit(".")))
        .otherwise(F.lit("Not a StarTrack routing barcode."))
    )


def atl(raw: Column, bare: Column) -> Column:
    c = bare
    return F.when(
        c.rlike(r"^C\d{9}\z"),
        F.struct(
            raw.alias("raw"),
            c.alias("atlNumber"),
            F.substring(c, 2, 9).alias("counter"),
            F.substring(c, 2, 9).try_cast("bigint").alias("counterNumber"),
        ),
    )


# The QR payload's fixed-width layout (name, start, length).
QR_FIELDS = [
    ("receiverSuburb", 1, 30),
    ("receiverPostcode", 31, 4),
    ("connoteNumber", 35, 12),
    ("freightItemNumber", 47, 20),
    ("productCode", 67, 3),
    ("payerAccount", 70, 8),
    ("senderAccount", 78, 8),
    ("consignmentQuantity", 86, 4),
    ("consignmentWeight", 90, 5),
    ("consignmentCube", 95, 5),
    ("despatchDate", 100, 8),
    ("receiverName1", 108, 40),
    ("receiverName2", 148, 40),
    ("unitType", 188, 3),
    ("destinationDepot", 191, 4),
    ("receiverAddress1", 195, 40),
    ("receiverAddress2", 235, 40),
    ("receiverPhone", 275, 14),
    ("dangerousGoodsIndicator", 289, 1),
    ("movementTypeIndicator", 290, 1),
    ("notBeforeDate", 291, 12),
    ("notAfterDate", 303, 12),
    ("atlNumber", 315, 10),
    ("raNumber", 325, 10),
]
QR_MIN_LENGTH = 290


def qr_text(raw: Column) -> Column:
    return F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\]Q[0-9]", "")


def qr(raw: Column, text: Column) -> Column:
    fields = {name: S.trim(F.substring(text, start, n)) for name, start, n in QR_FIELDS}
    product = fields["productCode"]
    return F.when(
        F.length(text) >= QR_MIN_LENGTH,
        F.struct(
            F.lit("startrack-qr").alias("type"),
            raw.alias("raw"),
            F.length(text).alias("length"),
            F.struct(*[c.alias(name) for name, c in fields.items()]).alias("fields"),
            product.alias("productCode"),
            R.freight_name(product).alias("productName"),
            R.freight_group(product).alias("productGroup"),
            R.freight_label_code(product).alias("expectedLabelCode"),
        ),
    )
