"""Risk categories: two vocabularies that are both in use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from evistrata.functions.text import title_case

#: The categories that extraction may give.
EXTRACTED = ("Supply Chain", "Geopolitical", "Export Controls", "Demand", "Competition", "Technology", "Legal/Regulatory", "Financial", "Other")
#: The categories of the stored register.
REGISTERED = ("Supply Chain", "Geopolitical", "Export Controls", "Demand", "Competition", "Technology", "Legal/Regulatory", "Financial", "Cybersecurity", "Other")
#: Words that decide a free-text category, in order of precedence.
KEYWORDS = {
    "Export Controls": ("export control", "export restriction", "export license", "entity list", "sanction", "trade restriction"),
    "Supply Chain": (
        "supply", "supplier", "manufactur", "foundry", "fabrication", "capacity constraint", "shortage", "logistics", "sourcing",
        "raw material", "component", "third-party dependence", "concentration of production",
    ),
    "Geopolitical": (
        "geopolit", "politic", "taiwan", "china", "tariff", "trade polic", "trade tension", "trade barrier", "trade war", "macroeconomic",
        "war", "conflict", "international relations", "cross-strait",
    ),
    "Competition": ("compet",),
    "Demand": ("demand", "customer concentration", "sales fluctuation", "seasonal", "market condition", "revenue concentration", "order cancellation"),
    "Technology": (
        "technolog", "innovation", "product development", "obsolescence", "cyber", "security breach", "information security",
        "artificial intelligence", "infrastructure", "system failure",
    ),
    "Legal/Regulatory": (
        "legal", "regulat", "litigation", "lawsuit", "compliance", "intellectual property", "patent", "antitrust", "privacy", "data protection", "governance",
    ),
    "Financial": (
        "financ", "currency", "exchange rate", "interest rate", "liquidity", "credit", "tax", "capital", "investment", "accounting", "impairment",
        "indebtedness", "stock price", "dividend",
    ),
}


def extracted_category(value: Column) -> Column:
    """A free-text category as one of EXTRACTED: by name, else by the first keyword list that meets it."""
    text = F.lower(F.trim(value))
    found = F.when(text.isNull() | (text == ""), "Other")
    for name in EXTRACTED:
        found = found.when(text == name.lower(), name)
    for name, words in KEYWORDS.items():
        meets = F.lit(False)
        for word in words:
            meets = meets | F.contains(text, F.lit(word))
        found = found.when(meets, name)
    return found.otherwise("Other")


def registered_category(value: Column) -> Column:
    """A category spelled as in REGISTERED, or else in title case; a blank one stays as it is."""
    text = F.trim(value)
    found = F.when(value.isNull() | (value == ""), value)
    for name in REGISTERED:
        found = found.when(F.lower(text) == name.lower(), name)
    return found.otherwise(title_case(text))
