"""What to scan for: the catalogue of entity types and the settings of one scan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

RANKS = {"low": 1, "medium": 2, "high": 3}
LANGUAGES = ("auto", "ru", "en")

# Display groups (id, Russian label, English label).
PII_GROUPS = (
    ("identity", "Личность и контакты", "Identity & contacts"),
    ("ru", "Документы РФ", "Russian documents"),
    ("us", "Документы США", "US documents"),
    ("financial", "Финансы", "Financial"),
    ("business", "Реквизиты компаний", "Company details"),
    ("tech", "Технические и секреты", "Technical & secrets"),
)

# Entity types (id, group, Russian label, English label, on by default).
PII_TYPES = (
    ("PERSON", "identity", "ФИО", "Names", True),
    ("DATE_OF_BIRTH", "identity", "Дата рождения", "Date of birth", False),
    ("EMAIL", "identity", "Email", "Email", True),
    ("PHONE", "identity", "Телефоны", "Phones", True),
    ("RU_INN", "ru", "ИНН", "INN (RU tax id)", True),
    ("RU_SNILS", "ru", "СНИЛС", "SNILS", True),
    ("RU_OGRN", "ru", "ОГРН", "OGRN", True),
    ("RU_PASSPORT", "ru", "Паспорт РФ", "RU passport", True),
    ("RU_DRIVER_LICENSE", "ru", "Водительское удостоверение", "RU driver license", True),
    ("RU_OMS", "ru", "Полис ОМС", "OMS policy", True),
    ("US_SSN", "us", "SSN (США)", "US SSN", True),
    ("US_EIN", "us", "EIN (Tax ID США)", "US EIN (tax id)", True),
    ("US_DRIVER_LICENSE", "us", "Driver License (США)", "US driver license", True),
    ("US_MEDICARE", "us", "Medicare (США)", "US Medicare", True),
    ("CARD", "financial", "Банковские карты", "Bank cards", True),
    ("IBAN", "financial", "IBAN", "IBAN", True),
    ("RU_BANK_ACCOUNT", "business", "Расчётный / корр. счёт (РФ)", "RU bank account", True),
    ("RU_BIK", "business", "БИК (РФ)", "BIK", True),
    ("RU_KPP", "business", "КПП (РФ)", "KPP", True),
    ("US_ROUTING", "business", "ABA routing (США)", "US ABA routing", True),
    ("US_BANK_ACCOUNT", "business", "Банковский счёт (США)", "US bank account", True),
    ("SWIFT_BIC", "business", "SWIFT / BIC", "SWIFT / BIC", True),
    ("US_DUNS", "business", "DUNS (США)", "US DUNS", True),
    ("IP_ADDRESS", "tech", "IP-адреса", "IP addresses", True),
    ("SECRET", "tech", "Секреты", "Secrets", True),
)

KNOWN_TYPES = tuple(t[0] for t in PII_TYPES)
DEFAULT_TYPES = tuple(t[0] for t in PII_TYPES if t[4])
SECRET_TYPES = ("SECRET_JWT", "SECRET_AWS", "SECRET_KV", "SECRET_ENTROPY")


@dataclass(frozen=True)
class ScanConfig:
    """Settings of a scan, resolved while the plan is built: a disabled detector leaves no trace in it.

    ``extra`` holds user rules (see :class:`veilframe.operators.detectors.Rule`).
    """

    enabled_types: tuple[str, ...] = DEFAULT_TYPES
    min_confidence: str = "medium"
    language: str = "auto"
    extra: tuple = field(default=())

    def __post_init__(self):
        object.__setattr__(self, "enabled_types", tuple(self.enabled_types))
        if self.min_confidence not in RANKS:
            raise ValueError(f"unknown confidence: {self.min_confidence!r}")
        if self.language not in LANGUAGES:
            raise ValueError(f"unknown language: {self.language!r}")

    @property
    def min_rank(self) -> int:
        return RANKS[self.min_confidence]

    def wants(self, type_: str) -> bool:
        return type_ in self.enabled_types

    @property
    def secret_types(self) -> tuple[str, ...]:
        """Secret rules to keep: all under the umbrella type, else those named."""
        return tuple(t for t in SECRET_TYPES if self.wants("SECRET") or self.wants(t))


def pii_types(spark: SparkSession) -> DataFrame:
    """The type catalogue as a small dimension table."""
    return spark.createDataFrame(
        list(PII_TYPES), "type string, `group` string, label_ru string, label_en string, default_on boolean")


def pii_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PII_GROUPS), "`group` string, label_ru string, label_en string")
