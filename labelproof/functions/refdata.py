"""Carrier reference data and the small dimension tables built from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Carrier codes published in the label specifications. They must
# equal the reference tables for results to agree.
# ---------------------------------------------------------------------------
STATES = ["ACT", "NSW", "NT", "QLD", "SA", "TAS", "VIC", "WA"]

PRODUCTS = {
    "00091": "Parcel Post (Non-Signature)",
    "00093": "Parcel Post + Signature",
    "00096": "Express Post + Signature",
    "00087": "Express Post (Non-Signature)",
    "00065": "Parcel Post Return",
    "00068": "Express Post Return",
}

# code: (name, description, authority to leave, partial delivery, safe drop)
SERVICES = {
    "03": ("Signature Required",
           "Signature on delivery always required. If signature cannot be obtained, parcel must be carded to Post Office.",
           False, False, False),
    "08": ("Authority To Leave", "Authority to leave if unattended.", True, False, False),
    "45": ("Partial Delivery Allowed", "Signature required with partial delivery allowed.", False, True, False),
    "15": ("ATL + Partial Delivery", "Authority to leave enabled with partial delivery allowed.", True, True, False),
    "50": ("Safe Drop Enabled", "Signature required with safe drop enabled.", False, False, True),
    "51": ("Safe Drop + Partial Delivery", "Safe drop enabled with partial delivery allowed.", False, True, True),
    "09": ("Non-Signature + ATL", "Authority to leave with non-signature service.", True, True, False),
    "49": ("Wine Delivery - Addressee Only",
           "Wine delivery requiring identity on delivery and addressee-only delivery.", False, False, False),
    "81": ("Wine Delivery - Signature", "Wine delivery with mandatory signature.", False, False, False),
    "82": ("Wine Delivery - ATL", "Wine delivery with authority to leave enabled.", True, True, False),
    "83": ("Wine Delivery - Safe Drop", "Wine delivery with safe drop enabled.", False, False, True),
}

SERVICE_PRODUCTS = {
    "03": ["00093", "00096", "00065", "00068"],
    "08": ["00093", "00096", "00065", "00068"],
    "45": ["00093", "00096"],
    "15": ["00093", "00096"],
    "50": ["00093", "00096"],
    "51": ["00093", "00096"],
    "09": ["00091", "00087"],
    "49": ["00093"],
    "81": ["00093"],
    "82": ["00093"],
    "83": ["00093"],
}

# Delivery flags shown in the service matrix report:
# code: (safe drop, signature, authority to leave, partial, no signature)
SERVICE_FLAGS = {
    "03": (False, True, False, False, False),
    "08": (False, False, True, False, False),
    "45": (False, True, False, True, False),
    "15": (False, False, True, True, False),
    "50": (True, False, False, False, False),
    "51": (True, False, False, True, False),
    "09": (False, False, False, True, True),
    "49": (False, True, False, False, False),
    "81": (False, True, False, False, False),
    "82": (False, False, True, False, False),
    "83": (True, False, False, False, False),
}
WINE_PRODUCT_NAME = "Parcel Post Signature (Wine)"
WINE_SERVICES = ["49", "81", "82", "83"]

# code: (name, group, routing label code)
FREIGHT_PRODUCTS = {
    "TSE": ("Tradeshow Express", "Special Services", "TSE"),
    "RET": ("Express Tail-Lift", "Special Services", "RET"),
    "RE2": ("Express Tail-Lift 2 man", "Special Services", "RE2"),
    "APT": ("Premium Tail-Lift", "Special Services", "APT"),
    "PRM": ("Premium", "Premium services", "PRM"),
    "FPP": ("1, 3 & 5Kg Fixed Price Premium", "Premium services", "PRM"),
    "ARL": ("Airlock", "Premium services", "ARL"),
    "FPA": ("1, 3 & 5Kg Fixed Price Airlock", "Premium services", "ARL"),
    "EXP": ("Express", "Express services", "EXP"),
}

UNIT_PRODUCTS = {
    "BAG": ["EXP", "PRM", "RET", "RE2", "FPP", "ARL", "FPA"],
    "CTN": ["EXP", "PRM", "RET", "RE2", "FPP", "ARL", "FPA"],
    "ITM": ["EXP", "PRM", "RET", "RE2", "FPP", "ARL", "FPA"],
    "JIF": ["EXP", "PRM", "RET", "RE2", "FPP", "ARL", "FPA"],
    "PAL": ["EXP", "PRM", "RET", "RE2"],
    "SAT": ["FPP", "FPA"],
    "SKI": ["EXP", "PRM", "RET", "RE2"],
}

UNKNOWN_PRODUCT = "Unknown product code"
UNKNOWN_SERVICE = "Unknown service code"
UNKNOWN_FREIGHT_PRODUCT = "Unknown StarTrack product code"

# ---------------------------------------------------------------------------


def label_code_products() -> dict[str, list[str]]:
    """Routing label code -> products that print it (reverse of FREIGHT_PRODUCTS)."""
    out: dict[str, list[str]] = {}
    for product, (_, _, label_code) in FREIGHT_PRODUCTS.items():
        out.setdefault(label_code, []).append(product)
    return out


def _sql(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return f"array({', '.join(_sql(x) for x in v)})"
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: Column, table: dict) -> Column:
    """Code table as a constant map: no join, no shuffle, null for unknown codes.

    The tables here have at most eleven entries and are part of the plan, so nothing
    that grows with the data is shipped with it."""
    entries = ", ".join(f"{_sql(k)}, {_sql(v)}" for k, v in table.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def product_name(code: Column) -> Column:
    return F.when(code.isNotNull(), F.coalesce(lookup(code, PRODUCTS), F.lit(UNKNOWN_PRODUCT)))


def service_name(code: Column) -> Column:
    return lookup(code, {c: v[0] for c, v in SERVICES.items()})


def service_description(code: Column) -> Column:
    return F.when(
        code.isNotNull(),
        F.coalesce(lookup(code, {c: f"{v[0]} - {v[1]}" for c, v in SERVICES.items()}), F.lit(UNKNOWN_SERVICE)),
    )


def service_flag(code: Column, which: str) -> Column:
    pos = {"authority_to_leave": 2, "allow_partial_delivery": 3, "safe_drop_enabled": 4}[which]
    return lookup(code, {c: v[pos] for c, v in SERVICES.items()})


def service_products(code: Column) -> Column:
    return lookup(code, SERVICE_PRODUCTS)


def freight_name(code: Column) -> Column:
    return F.coalesce(lookup(code, {c: v[0] for c, v in FREIGHT_PRODUCTS.items()}), F.lit(UNKNOWN_FREIGHT_PRODUCT))


def freight_group(code: Column) -> Column:
    return F.coalesce(lookup(code, {c: v[1] for c, v in FREIGHT_PRODUCTS.items()}), F.lit("Unknown"))


def freight_label_code(code: Column) -> Column:
    return lookup(code, {c: v[2] for c, v in FREIGHT_PRODUCTS.items()})


def unit_products(code: Column) -> Column:
    return lookup(code, UNIT_PRODUCTS)


def label_codes() -> list[str]:
    return list(label_code_products())


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The code tables as dimension DataFrames, for joins and for reports."""
    products = spark.createDataFrame(list(PRODUCTS.items()), "product_code string, product_name string")
    services = spark.createDataFrame(
        [(c, *v, "addressee" if c == "49" else None) for c, v in SERVICES.items()],
        "service_code string, service_name string, service_description string, authority_to_leave boolean, "
        "allow_partial_delivery boolean, safe_drop_enabled boolean, id_capture_type string",
    )
    matrix = spark.createDataFrame(
        [
            (c, p, WINE_PRODUCT_NAME if c in WINE_SERVICES else PRODUCTS[p], i, j, *SERVICE_FLAGS[c])
            for i, (c, ps) in enumerate(SERVICE_PRODUCTS.items())
            for j, p in enumerate(ps)
        ],
        "service_code string, product_code string, product_name string, service_ord int, product_ord int, "
        "flag_safe_drop boolean, flag_signature boolean, flag_atl boolean, flag_partial boolean, "
        "flag_no_signature boolean",
    )
    freight = spark.createDataFrame(
        [(c, *v) for c, v in FREIGHT_PRODUCTS.items()],
        "product_code string, product_name string, product_group string, label_code string",
    )
    units = spark.createDataFrame(
        [(u, p) for u, ps in UNIT_PRODUCTS.items() for p in ps], "unit_type string, product_code string"
    )
    label_code_dim = freight.groupBy("label_code").agg(
        F.array_sort(F.collect_list("product_code")).alias("supported_products")
    )
    return {
        "products": products,
        "services": services,
        "service_products": matrix,
        "freight_products": freight,
        "label_codes": label_code_dim,
        "units": units,
    }
