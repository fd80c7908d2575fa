"""Person names: Russian given names, surnames, patronymics and initials; English titles and capitalised pairs."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import RANKS, ScanConfig
from veilframe.functions.spans import bracket, no_pieces
from veilframe.operators.detectors import B, E, S, Rule, Views, candidate, own_kind

RU_ORD, RU_INITIALS_ORD, EN_TITLE_ORD, EN_PAIR_ORD = 110, 111, 112, 113

# Russian given names (nominative, then short forms), case endings, surname and patronymic suffixes.
GIVEN_NAMES = """
Александр Александра Алексей Алёна Алена Алина Алиса Анастасия Анатолий Андрей Анна Антон Артём Артем Артур
Борис Вадим Валентин Валентина Валерий Валерия Василий Василиса Вера Вероника Виктор Виктория Виталий Владимир
Владислав Галина Геннадий Георгий Глеб Григорий Даниил Дария Дарья Денис Диана Дмитрий Ева Евгений Евгения Егор
Екатерина Елена Елизавета Жанна Зинаида Зоя Иван Игорь Илья Инна Ирина Кирилл Кристина Ксения Лариса Леонид Лидия
Любовь Людмила Маргарита Марина Мария Марк Матвей Михаил Надежда Наталья Наталия Никита Николай Нина Оксана Олег
Олеся Ольга Павел Петр Пётр Полина Раиса Ринат Роман Руслан Светлана Святослав Семён Семен Сергей Снежана София
Софья Станислав Степан Тамара Татьяна Тимофей Тимур Ульяна Фёдор Федор Филипп Юлия Юрий Яна Ярослав
Саша Шура Лёша Леша Алеша Настя Андрюша Аня Тёма Тема Вася Вика Володя Вова Галя Гриша Даня Даша Женя Катя
Лена Лиза Ваня Гоша Ира Кира Костя Ксюша Люба Люда Рита Маша Миша Надя Наташа Коля Оля Паша Петя Поля
Света Сеня Серёжа Сережа Соня Стас Таня Тима Уля Федя Юля Юра Слава Дима Максим Макс Лев Ангелина Арина Богдан
Варвара Варя Герман Злата Карина Лилия Милана Мирон Платон Тихон Эльвира Эмилия Юлиана Ярослава
""".split()
NAME_ENDINGS = "ией ьей ьёй ями ами ой ей ёй ом ем ём ии ию ье ьи ью а я у ю е и ы й ь о".split()
SURNAME = (
    "(?iu)(?:[оеё]в(?:а|у|е|ой|ою|ым|ы|ых)?|[иы]н(?:а|у|е|ой|ою|ым|ы|ых)?"
    "|[сц]к(?:ий|ого|ому|им|ом|ая|ой|ою|ую|ие|их)|ко|ук|юк|дзе|ян(?:а|у|ом|е)?)$"
)
PATRONYMIC = "(?iu)(?:вич(?:а|у|ем|е)?|вн(?:а|ы|е|у|ой|ою)|ичн(?:а|ы|е|у|ой|ою)|оглы|кызы)$"
RU_HINT = "[А-ЯЁ][а-яё]|[А-ЯЁ]\\."
RU_WORD = "(?<![А-ЯЁа-яёA-Za-z])[А-ЯЁ][а-яё]+(?:-[А-ЯЁ][а-яё]+)?"
RU_INITIALS = rf"[А-ЯЁ][а-яё]+[{S}][А-ЯЁ]\.[{S}]?[А-ЯЁ]\.|[А-ЯЁ]\.[{S}]?[А-ЯЁ]\.[{S}][А-ЯЁ][а-яё]+"
EN_TITLED = rf"{B}(?:Mr|Mrs|Ms|Dr|Prof)\.?[{S}]+[A-Z][a-z]+(?:[{S}][A-Z][a-z]+)?{E}"
EN_PAIR_HINT = rf"[A-Z][a-z]+[{S}][A-Z][a-z]"
EN_PAIR = rf"(?=[A-Z])(?<![.!?][{S}]){B}[A-Z][a-z]+[{S}][A-Z][a-z]+{E}"

# Words that make a capitalised English pair a place, an organisation, a date or a greeting.
NOT_NAMES = """
New York Los Angeles San Francisco Diego Jose Antonio Las Vegas United States Kingdom North South East West
Great Britain Hong Kong Sri Lanka Costa Rica Puerto Rico Saudi Arabia South Africa Middle Silicon Valley Wall Street
LLC Inc Corp Ltd Company Group Team Project Data Systems Solutions Technologies Services Holdings Partners Labs
Machine Learning Artificial Intelligence Open Source
January February March April June July August September October November December
Monday Tuesday Wednesday Thursday Friday Saturday Sunday
Best Regards Kind Dear Hello Thank Thanks Please Note
""".split()


@lru_cache(maxsize=1)
def known_name_pattern() -> str:
    """A stem of a listed name, alone or with a case ending. A stem is the name without its last vowel sign."""
    stems = {n[:-1] if n.endswith("ия") or n[-1] in "аяйьоеи" else n for n in map(str.lower, GIVEN_NAMES)}
    return f"^(?:{'|'.join(sorted(stems))})(?:{'|'.join(NAME_ENDINGS)})?$"


def is_known_name(word: Column) -> Column:
    return F.lower(word).rlike(known_name_pattern())


def person_rules(cfg: ScanConfig) -> list[Rule]:
    """Initials, titled names and capitalised pairs as rules. Russian patterns need Cyrillic letters and English
    ones Latin letters by themselves, so language ``auto`` runs both."""
    common = {"validator": "heuristic", "needs_digits": False}
    rules = []
    if cfg.wants("PERSON") and cfg.language != "en":
        rules.append(Rule("PERSON", RU_INITIALS, confidence="high", hint=RU_HINT, ord=RU_INITIALS_ORD, **common))
    if cfg.wants("PERSON") and cfg.language != "ru":
        stop = "|".join(dict.fromkeys(NOT_NAMES))
        rules.append(Rule("PERSON", EN_TITLED, confidence="high", words=("mr", "ms", "dr", "prof"),
                          ord=EN_TITLE_ORD, **common))
        rules.append(Rule("PERSON", EN_PAIR, hint=EN_PAIR_HINT, ord=EN_PAIR_ORD, **common, check=lambda h: ~h.match.rlike(
            f"^(?:{stop})[{S}]|[{S}](?:{stop})$")))
    return rules


def wants_ru_words(cfg: ScanConfig) -> bool:
    return cfg.wants("PERSON") and cfg.language != "en"


def ru_word_pieces(views: Views) -> Column:
    """Capitalised Russian words, bracketed."""
    return F.when(~views.ascii & views.plain.rlike(RU_HINT), bracket(views.plain, RU_WORD)).otherwise(no_pieces())


def ru_names(words: Column) -> Column:
    """Candidates from the placed Russian words (a materialised column): one per word that is a known given name
    or closes a full name."""

    def at(i: Column) -> Column:
        return F.get(words, i)

    def name(w: Column, i: Column) -> Column:
        before, before2, after = at(i - 1), at(i - 2), at(i + 1)

        def found(start: Column, end: Column, level: str) -> Column:
            return F.struct(start.alias("start"), end.alias("end"), F.lit(RANKS[level]).alias("rank"))

        full = (
            (i >= 2) & w["match"].rlike(PATRONYMIC)
            & (w["start"] - before["end"] <= 2) & (before["start"] - before2["end"] <= 2))
        then_surname = (after["start"] == w["end"] + 1) & after["match"].rlike(SURNAME)
        after_surname = (i > 0) & (before["end"] == w["start"] - 1) & before["match"].rlike(SURNAME)
        known = is_known_name(w["match"])
        return F.when(full, found(before2["start"], w["end"], "high")) \
            .when(known & then_surname, found(w["start"], after["end"], "high")) \
            .when(known & after_surname, found(before["start"], w["end"], "high")) \
            .when(known, found(w["start"], w["end"], "medium"))

    names = F.filter(F.transform(words, name), lambda n: n.isNotNull())
    return F.transform(names, lambda n: candidate(
        n["start"], n["end"], F.lit(RU_ORD), F.lit("PERSON"), n["rank"], F.lit("heuristic"), F.lit(own_kind("PERSON"))))
