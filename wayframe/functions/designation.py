"""Route designations read from names and codes (P-20..P-26, P-29..P-31, P-38, P-41).

Each builder returns one Column, so a whole road table is read in a single narrow pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# ---------------------------------------------------------------- road names (P-20)
# What a trailing or leading word says about a numbered road.
QUALIFIER_WORDS = {
    "bus": "business", "busn": "business", "business": "business", "buslp": "business",
    "businesslp": "business", "busloop": "business", "businessloop": "business",
    "bypass": "bypass", "byp": "bypass", "bypss": "bypass",
    "alt": "alternate", "alternate": "alternate", "trk": "truck", "truck": "truck",
    "spur": "spur", "spr": "spur", "con": "connector", "conn": "connector", "connector": "connector",
    "loop": "loop", "lp": "loop", "hov": "hov", "opt": "optional",
    "sci": "scenic", "scn": "scenic", "scenic": "scenic",
}

# Pattern parts.
_NUM = r"[a-z]?\d{1,4}[a-z]?"
_LIST = rf"{_NUM}(?:/{_NUM})*"
_ROAD = r"(?:hwy|highway|rte|route|rd|road)"
_VARIANT = r"(?:loop|lp|spur|spr|byp|bypass|bus|business|alt|alternate|trk|truck|conn|connector)"
_REST = r"\b\s*(.*)$"

# Naming rules in order; the first that matches wins.
# (jurisdiction or None, system, pattern, group of the variant word or 0, group of the number, prefix)
NAME_RULES = [
    (None, "us-interstate", rf"(?i)^i-?\s*h-?(\d{{1,3}}){_REST}", 0, 1, "H"),
    (None, "us-interstate", rf"(?i)^i-?\s*(\d{{1,3}}[a-z]?){_REST}", 0, 1, ""),
    (None, "us-numbered", rf"(?i)^u\.?s\.?\s*{_ROAD}?\s*({_LIST}){_REST}", 0, 1, ""),
    (None, "us-state", rf"(?i)^(?:state|st)\s+({_VARIANT})\s*{_ROAD}?\s*({_NUM}){_REST}", 1, 2, ""),
    (None, "us-state", rf"(?i)^({_VARIANT})\s+(?:rte|route)\s*({_NUM}){_REST}", 1, 2, ""),
    (None, "us-state", rf"(?i)^(?:state|st)\s*{_ROAD}\s*({_LIST}){_REST}", 0, 1, ""),
    (None, "us-state", rf"(?i)^(?:rte|route)\s*({_LIST}){_REST}", 0, 1, ""),
    ("AK", "us-state", rf"(?i)^ak\s*-?\s*{_ROAD}?\s*({_NUM}){_REST}", 0, 1, ""),
    ("PR", "us-state", rf"(?i)^(?:carr\s*)?(?:pr|estatal|num)?\s*-?\s*({_NUM}){_REST}", 0, 1, ""),
    ("TX", "us-state", rf"(?i)^(?:fm|f m)\s*-?\s*({_NUM}){_REST}", 0, 1, "FM"),
    ("TX", "us-state", rf"(?i)^(?:rm|ranch\s*rd|ranch\s*road)\s*-?\s*({_NUM}){_REST}", 0, 1, "RM"),
    ("TX", "us-state", rf"(?i)^(loop|lp|spur|spr)\s+({_NUM}){_REST}", 1, 2, ""),
    ("HI", "us-state", rf"(?i)^hi\s*-\s*({_NUM}){_REST}", 0, 1, ""),
    ("MO", "us-state", r"(?i)^(?:state\s*)?(?:rte|route|hwy|highway)\s+([a-z]{1,3})\b\s*(.*)$", 0, 1, ""),
]

_ROUTE_TYPE = "array<struct<system:string,number:string,qualifier:string>>"


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(pairs, key)


def designations(name: Column, road_type: Column, state: Column, lettered: list[str] | None = None) -> Column:
    """P-20: routes written in a road name: array of (system, number, qualifier).

    ``lettered`` lists the suffixed numbers that really exist, so that a spaced letter is
    read as a suffix only where there is such a road.
    """
    raw = F.trim(F.coalesce(name, F.lit("")))
    kind = F.upper(F.trim(F.coalesce(road_type, F.lit(""))))
    st = F.coalesce(state, F.lit(""))
    states_itself = (((st == "PR") & raw.rlike(r"(?i)^(?:pr\b|carr\b)")) | raw.rlike(r"(?i)^i-\s*\d")
                     | ((st == "TX") & raw.rlike(r"(?i)^(?:[nsew]\s+)?(?:loop|spur)\s+\d")))
    wanted = ((raw != "") & (kind != "C") & ((kind != "M") | states_itself)
              & ~raw.rlike(r"(?i)^(?:old|hst|hist|historic)\s+"))

    plain = F.regexp_replace(raw, r"(?i)^(?:n|s|e|w|ne|nw|se|sw)\s+", "")
    spaced = r"(?i)^(i-?\s*)(\d{1,3})\s+([a-z])\b"
    suffixed = F.upper(F.concat(F.regexp_extract(plain, spaced, 2), F.regexp_extract(plain, spaced, 3)))
    plain = F.when(suffixed.isin(*(lettered or ["-"])), F.regexp_replace(plain, spaced, "$1$2$3")).otherwise(plain)
    plain = F.regexp_replace(plain, r"(?i)\s*\b(?:n|s|e|w|ne|nw|se|sw|nb|sb|eb|wb)\b\s*$", "")
    plain = F.regexp_replace(plain, r"(?i)\b([A-Z]) (\d)", "$1$2")
    plain = F.regexp_replace(plain, r"(?i)\b(\d) ([A-Z])(?![A-Za-z])", "$1$2")

    nothing = F.array().cast(_ROUTE_TYPE)
    # Bound by a lambda, so that the cleaned name is worked out once and not once per rule.
    read = F.get(F.transform(F.array(plain), lambda p: F.coalesce(*_tried(p, st), nothing)), 0)
    return F.when(wanted, read).otherwise(nothing)


def _tried(plain: Column, st: Column) -> list[Column]:
    """What each naming rule makes of a cleaned name; null where it does not apply."""
    nothing = F.array().cast(_ROUTE_TYPE)
    tried = []
    for rule_state, system, pattern, variant, number, prefix in NAME_RULES:
        last = 3 if variant else 2
        rest = F.regexp_replace(F.lower(F.regexp_extract(plain, pattern, last)), "[^a-z]", "")
        if variant:
            word = F.lower(F.regexp_extract(plain, pattern, variant))
            qualifier, readable = F.coalesce(_lookup(QUALIFIER_WORDS, word), word), F.lit(True)
        else:
            qualifier = _lookup(QUALIFIER_WORDS, rest)
            readable = (rest == "") | qualifier.isNotNull()
        found = F.transform(F.split(F.upper(F.regexp_extract(plain, pattern, number)), "/"), lambda n: F.struct(
            F.lit(system).alias("system"), F.concat(F.lit(prefix), n).alias("number"), qualifier.alias("qualifier")))
        applies = plain.rlike(pattern) if rule_state is None else (st == rule_state) & plain.rlike(pattern)
        tried.append(F.when(applies, F.when(readable, found).otherwise(nothing)))
    return tried


# ---------------------------------------------------------------- coded fields (P-21, P-22)
# Fixed value: prefix, number or letters, suffix letter.
CODED_ROUTE = r"^([A-Z]{2,4})?[\s-]*([0-9]{1,4}|[A-Z]{2,4})[\s-]*([A-Z])?$"


def coded_routes(value: Column) -> Column:
    """P-21: a coded list as distinct (prefix, number, toll); numbers padded to three digits."""
    pieces = F.filter(F.transform(F.split(F.upper(F.coalesce(T.null_if_sentinel(value), F.lit(""))), r"[/,;]+"), lambda x: F.trim(x)),
                      lambda p: p.rlike(CODED_ROUTE))

    def read(p: Column) -> Column:
        body, suffix = F.regexp_extract(p, CODED_ROUTE, 2), F.regexp_extract(p, CODED_ROUTE, 3)
        padded = F.when(body.rlike(r"^\d{1,2}$"), F.lpad(body, 3, "0")).otherwise(body)
        prefix = F.regexp_extract(p, CODED_ROUTE, 1)
        return F.struct(F.when(prefix != "", prefix).alias("prefix"), F.concat(padded, suffix).alias("number"),
                        (suffix == "D").alias("toll"))

    return F.array_distinct(F.transform(pieces, read))


def rejected_codes(value: Column) -> Column:
    """P-21: the pieces of a coded list that name no route."""
    pieces = F.transform(F.split(F.upper(F.coalesce(T.null_if_sentinel(value), F.lit(""))), r"[/,;]+"), lambda x: F.trim(x))
    return F.filter(pieces, lambda p: (p != "") & ~p.rlike(CODED_ROUTE))


def route_prefix(jurisdiction: Column, federation: str = "federal") -> Column:
    """P-21: prefix given by the administering body."""
    return F.when(jurisdiction == federation, "MEX").when(jurisdiction == "MEX", "EM").otherwise(jurisdiction)


# Fixed value: a plain number with up to two letters, or letters alone.
FIELD_NUMBER = r"^(?:[1-9]\d{0,3}[A-Z]{0,2}|[A-Z]{2,4})$"


def field_numbers(*fields: Column) -> Column:
    """P-22: parallel number fields as one set of valid numbers."""
    cleaned = [F.upper(F.regexp_replace(T.null_if_sentinel(f), r"^(\d+)\.0+$", "$1")) for f in fields]
    return F.array_distinct(F.filter(F.array_compact(F.array(*cleaned)), lambda n: n.rlike(FIELD_NUMBER)))


# ---------------------------------------------------------------- references (P-23, P-24)
# Fixed value: letter, digits, suffix.
REF = r"^([GS])(\d{1,4})([A-Z]\d{0,2})?$"


def parse_ref(raw: Column) -> Column:
    """P-23: a reference token; superseded ones, odd zeros and long suffixed ones are null."""
    s = F.trim(T.half_width(raw))
    body = F.upper(F.regexp_replace(F.split(s, "[（(]")[0], r"\s+", ""))
    digits, suffix = F.regexp_extract(body, REF, 2), F.regexp_extract(body, REF, 3)
    ok = (~s.rlike(r"(?i)旧|old|原") & body.rlike(REF)
          & ~(digits.startswith("0") & (F.length(digits) < 4)) & ~((suffix != "") & (F.length(digits) > 2)))
    return F.when(ok, body)


def classify_ref(ref: Column) -> Column:
    """P-23: struct(system, tier) of a reference, by letter and digit count."""
    letter, digits, suffix = (F.regexp_extract(ref, REF, i) for i in (1, 2, 3))
    n = F.length(digits)
    expressway = (n <= 2) | (n == 4)
    system = F.when((letter == "G") & expressway, "cn-expressway").when(letter == "G", "cn-national").when(letter == "S", "cn-provincial")
    tier = (F.when((letter == "G") & expressway, F.when((n <= 2) & (suffix == ""), "primary").otherwise("auxiliary"))
            .when(letter == "G", F.when(digits.try_cast("int") < 500, "primary").otherwise("auxiliary"))
            .when(letter == "S", "state"))
    return F.when(ref.rlike(REF), F.struct(system.alias("system"), tier.alias("tier")))


# Stem suffixes and the letters that stand for them.
STEMS = {"甲": "A", "乙": "B", "丙": "C", "丁": "D", "戊": "E", "己": "F", "庚": "G"}
STEM_NUMBER = r"^(國|台|臺)(\d+)([甲乙丙丁戊己庚]?)(臨\d+)?$"


def stem_number(raw: Column) -> Column:
    """P-24: struct(system, number) of a stem-suffixed number; provisional routes are null."""
    s = F.trim(raw)
    stem = F.coalesce(_lookup(STEMS, F.regexp_extract(s, STEM_NUMBER, 3)), F.lit(""))
    number = F.concat(F.regexp_extract(s, STEM_NUMBER, 2).try_cast("int").cast("string"), stem)
    system = F.when(F.regexp_extract(s, STEM_NUMBER, 1) == "國", "tw-freeway").otherwise("tw-provincial")
    return F.when(s.rlike(STEM_NUMBER) & (F.regexp_extract(s, STEM_NUMBER, 4) == ""),
                  F.struct(system.alias("system"), number.alias("number")))


# ---------------------------------------------------------------- tag dialects (P-25)
def dialect_keys(country: str, refs: Column, road_class: Column) -> Column:
    """P-25: a tag's reference list as match keys, in a country's way of writing them."""
    separators = r"[;,，；]" if country in ("cn", "tw") else r"[;,]"
    tokens = F.split(F.coalesce(refs, F.lit("")), separators)
    if country == "cn":
        def key(t):
            return F.coalesce(parse_ref(t), F.when(t.rlike(r"^\s*([1-9]|10)\s*$"), F.concat(F.lit("HK"), F.trim(t))))
    elif country == "tw":
        pattern = r"^(國道?|台|臺)?(\d{1,2})(號|線)?([甲乙丙丁戊己庚辛壬癸])?(線)?$"

        def key(t):
            s = F.regexp_replace(t, r"\s+", "")
            mark, stem = F.regexp_extract(s, pattern, 1), F.regexp_extract(s, pattern, 4)
            freeway = mark.startswith("國") | ((mark == "") & (F.coalesce(road_class, F.lit("")) == "motorway"))
            letter = F.coalesce(_lookup(STEMS, stem), F.lit(""))
            return F.when(s.rlike(pattern) & ~(freeway & (stem != "")), F.concat(
                F.when(freeway, "F").otherwise("P"), F.regexp_extract(s, pattern, 2).try_cast("int").cast("string"), letter))
    elif country == "mx":
        federal = r"^(?:MEX|FED(?:ERAL)?|CARRETERA FEDERAL)[\s.-]*(\d{1,3})([A-Z])?$"
        local = r"^([A-Z]{2,4})[\s.-]+(\d{1,3})([A-Z])?$"

        def key(t):
            s = F.upper(F.trim(t))
            return (F.when(s.rlike(federal), F.concat(F.lit("MEX-"), F.lpad(F.regexp_extract(s, federal, 1), 3, "0"),
                                                      F.regexp_extract(s, federal, 2)))
                    .when(s.rlike(local) & (F.regexp_extract(s, local, 1) != "MEX"), F.concat(
                        F.regexp_extract(s, local, 1), F.lit("-"), F.lpad(F.regexp_extract(s, local, 2), 3, "0"),
                        F.regexp_extract(s, local, 3))))
    else:
        raise ValueError(f"no reference dialect for {country!r}")
    return F.array_distinct(F.array_compact(F.transform(tokens, key)))


def route_key(country: Column, system: Column, number: Column, label: Column) -> Column:
    """P-25: the match key of a route of ours."""
    return (F.when(country == "cn", number).when(country == "hk", F.concat(F.lit("HK"), number))
            .when(country == "tw", F.concat(F.when(system == "tw-freeway", "F").otherwise("P"), number))
            .when(country == "mx", F.upper(label)))


# ---------------------------------------------------------------- route ids (P-26)
# Fixed values: (jurisdiction, pattern, {letters: (system, prefix)}).
ID_RULES = [
    ("TX", r"^(IH|US|SH|FM|RM|SL|SS|BI|BU|BS)(\d{4})", {
        "IH": ("us-interstate", ""), "BI": ("us-interstate", ""), "US": ("us-numbered", ""), "BU": ("us-numbered", ""),
        "SH": ("us-state", ""), "FM": ("us-state", "FM"), "RM": ("us-state", "RM"), "SL": ("us-state", ""),
        "SS": ("us-state", ""), "BS": ("us-state", "")}),
    ("MA", r"^(I|US|SR)(\d{1,4})", {"I": ("us-interstate", ""), "US": ("us-numbered", ""), "SR": ("us-state", "")}),
    ("MD", r"^\d{5}(IS|US|MD)(\d{5})", {"IS": ("us-interstate", ""), "US": ("us-numbered", ""), "MD": ("us-state", "")}),
]


def from_route_id(state: Column, route_id: Column) -> Column:
    """P-26: struct(system, number) of a section id, for jurisdictions that leave the number blank."""
    rid = F.upper(F.trim(route_id))
    tried = []
    for st, pattern, systems in ID_RULES:
        letters = F.regexp_extract(rid, pattern, 1)
        number = F.regexp_extract(rid, pattern, 2).try_cast("int")
        system = _lookup({k: v[0] for k, v in systems.items()}, letters)
        prefix = F.coalesce(_lookup({k: v[1] for k, v in systems.items()}, letters), F.lit(""))
        tried.append(F.when((state == st) & (number > 0), F.struct(
            system.alias("system"), F.concat(prefix, number.cast("string")).alias("number"))))
    return F.coalesce(*tried)


def section_route(province: str, section_id: Column) -> Column:
    """P-26: route number packed in a provincial section id."""
    s = F.trim(section_id)
    # Layout of the three provincial ids.
    layout = {"QC": r"^(\d{1,5})", "NB": r"^R(\d{4})\d{3}$", "PE": r"^(\d{3})\d{2}$"}[province]
    n = F.regexp_extract(s, layout, 1).try_cast("int")
    return F.when((n > 0) & ((n < 1000) if province == "QC" else F.lit(True)), n.cast("string"))


# ---------------------------------------------------------------- vocabularies (P-29, P-31)
# Road classes and the shared type vocabulary.
CANADIAN_CLASSES = {
    "Freeway": "Freeway", "Expressway / Highway": "Primary", "Arterial": "Primary", "Collector": "Secondary",
    "Ramp": "Ramp", "Service Lane": "Secondary", "Local / Street": "Local", "Local / Strata": "Local",
    "Local / Unknown": "Local", "Alleyway / Lane": "Local", "Resource / Recreation": "Secondary",
    "Winter": "Winter", "Winter Road": "Winter",
}
TRAFFIC_DIRECTIONS = {"Same direction": "Divided", "Opposite direction": "Divided", "Both directions": "Undivided"}
MEXICAN_CLASSES = {
    "Carretera": "Primary", "Periférico": "Primary", "Viaducto": "Primary", "Eje vial": "Primary",
    "Camino": "Secondary", "Calzada": "Secondary", "Boulevard": "Secondary", "Avenida": "Secondary",
    "Calle": "Local", "Privada": "Local", "Prolongación": "Local", "Andador": "Local", "Peatonal": "Local",
    "Vereda": "Unpaved", "Brecha": "Unpaved", "Enlace": "Ramp", "Rampa de frenado": "Ramp",
    "Retorno": "Ramp", "Retorno U": "Ramp", "Glorieta": "Ramp",
}
UNPAVED_SURFACES = ("unpaved", "gravel", "dirt", "ground", "earth", "sand", "grass", "compacted", "fine_gravel", "mud")


def mapped(value: Column, vocabulary: dict[str, str], default: str | None = None) -> Column:
    """P-29: translate a code by a fixed vocabulary."""
    found = _lookup(vocabulary, value)
    return found if default is None else F.coalesce(found, F.lit(default))


def tag_type(road_class: Column, surface: Column) -> Column:
    """P-29: road type of a tagged way."""
    return (F.when(surface.isin(*UNPAVED_SURFACES), "Unpaved").when(road_class == "motorway", "Freeway")
            .when(road_class.isin("trunk", "primary"), "Primary").when(road_class == "secondary", "Secondary")
            .when(road_class == "track", "Unpaved").otherwise("Other Paved"))


def is_open(status: Column, condition: Column) -> Column:
    """P-31: only roads in service; silence counts as open."""
    closed = r"(?i)en construcci|proyecto|fuera de servicio|abandon|clausurad"
    return ~F.coalesce(status, F.lit("")).rlike(closed) & ~F.coalesce(condition, F.lit("")).rlike(closed)


# ---------------------------------------------------------------- tiers, labels, slugs (P-30)
# Number prefix of each qualifier, and its label tag.
QUALIFIER_PREFIX = {"business": "BUS", "alternate": "ALT", "bypass": "BYP", "truck": "TRK", "spur": "SPUR",
                    "connector": "CONN", "loop": "LOOP", "hov": "HOV", "scenic": "SCN", "optional": "OPT"}
QUALIFIER_TAG = {"alternate": " Alt", "business": " Bus", "bypass": " Byp", "truck": " Trk"}


def raw_number(number: Column, qualifier: Column) -> Column:
    return F.concat(F.coalesce(_lookup(QUALIFIER_PREFIX, qualifier), F.lit("")), number)


def tier(system: Column, number: Column, qualifier: Column) -> Column:
    """P-30: state, special, primary (up to two characters) or auxiliary."""
    base = F.regexp_extract(number, r"^([A-Z]*\d+)[A-Z]*$", 1)
    return (F.when(system == "us-state", "state").when(qualifier.isNotNull() | (base == ""), "special")
            .when(F.length(base) <= 2, "primary").otherwise("auxiliary"))


def label(system: Column, number: Column, qualifier: Column, state: Column) -> Column:
    """P-30: the designation as it is signed."""
    hawaii = number.rlike(r"^H\d")
    interstate = (F.when(qualifier == "business", F.concat(F.lit("Business I-"), number))
                  .when(hawaii, F.regexp_replace(number, r"^([A-Z]+)(\d)", "$1-$2"))
                  .otherwise(F.concat(F.lit("I-"), number)))
    us = F.concat(F.lit("US "), number, F.coalesce(_lookup(QUALIFIER_TAG, qualifier), F.lit("")))
    raw = raw_number(number, qualifier)
    state_no = (F.when((state == "TX") & raw.rlike(r"^(FM|RM)\d+$"), F.regexp_replace(raw, r"^(FM|RM)(\d+)$", "$1 $2"))
                .when((state == "MI") & raw.rlike(r"^M\d+$"), F.regexp_replace(raw, r"^M", "M-")).otherwise(raw))
    return (F.when(system == "us-interstate", interstate).when(system == "us-numbered", us)
            .otherwise(F.concat(state, F.lit(" "), state_no)))


def provincial_label(system: Column, province: Column, number: Column) -> Column:
    """P-30: Canadian label; Quebec's 1-99 and 400 and over are autoroutes."""
    n = F.regexp_extract(number, r"^(\d{1,3})$", 1).try_cast("int")
    return (F.when(system == "ca-tch", F.concat(F.lit("TCH "), number))
            .when((province == "QC") & ((n <= 99) | (n >= 400)), F.concat(F.lit("A-"), number))
            .otherwise(F.concat(province, F.lit(" "), number)))


def route_group(system: Column, tier_: Column, raw: Column, state: Column) -> Column:
    """Grouping key: state and special routes are numbered per jurisdiction."""
    return F.when((system == "us-state") | (tier_ == "special"), F.concat_ws("|", system, raw, F.coalesce(state, F.lit("XX")))) \
        .otherwise(F.concat_ws("|", system, raw))


# ---------------------------------------------------------------- composite keys and headings (P-38, P-39)
def composite_key(text: Column) -> Column:
    """P-38: a dash-separated key in which a prefix applies to the numbers after it.

    Returns struct(routes, prefixes, toll, shared).
    """
    tokens = F.filter(F.transform(F.split(T.fold(F.coalesce(text, F.lit(""))), "-"), lambda x: F.trim(x)), lambda t: t != "")
    blank = F.struct(F.lit(None).cast("string").alias("prefix"), F.array().cast("array<string>").alias("routes"),
                     F.array().cast("array<string>").alias("prefixes"), F.lit(False).alias("toll"))

    def step(acc: Column, t: Column) -> Column:
        number, letter = t.rlike(r"^\d+[A-Z]?$"), t.rlike(r"^[A-Z]$")
        body, suffix = F.regexp_extract(t, r"^(\d+)([A-Z]?)$", 1), F.regexp_extract(t, r"^(\d+)([A-Z]?)$", 2)
        padded = F.when(F.length(body) < 3, F.lpad(body, 3, "0")).otherwise(body)
        return F.struct(
            F.when(number | letter, acc["prefix"]).otherwise(t).alias("prefix"),
            F.when(number & acc["prefix"].isNotNull(),
                   F.array_append(acc["routes"], F.concat(acc["prefix"], F.lit("-"), padded, suffix))).otherwise(acc["routes"]).alias("routes"),
            F.when(number | letter, acc["prefixes"]).otherwise(F.array_append(acc["prefixes"], t)).alias("prefixes"),
            (acc["toll"] | (number & (suffix == "D")) | (letter & (t == "D"))).alias("toll"))

    def done(acc: Column) -> Column:
        routes, prefixes = F.array_distinct(acc["routes"]), F.array_distinct(acc["prefixes"])
        return F.struct(routes.alias("routes"), prefixes.alias("prefixes"), acc["toll"].alias("toll"),
                        ((F.size(prefixes) > 1) & (F.size(routes) < F.size(prefixes))).alias("shared"))

    return F.aggregate(tokens, blank, step, done)


def heading(text: Column) -> Column:
    """P-39: struct(juris, toll) stated by a section heading; null juris means not recognised."""
    t = T.fold(text)
    federal, state = t.rlike(r"\bFEDERAL(ES)?\b"), t.rlike(r"\bESTATAL(ES)?\b")
    juris = F.when(federal & state, "mixed").when(federal, "federal").when(state, "state")
    toll = (F.when(t.rlike(r"LIBRES?\s+Y\s+DE\s+CUOTA"), "mixed").when(t.rlike(r"\bDE\s+CUOTA\b"), "toll")
            .when(t.rlike(r"\bLIBRE\b"), "free"))
    return F.struct(juris.alias("juris"), toll.alias("toll"))


# ---------------------------------------------------------------- number classes (P-41)
# Per system, the ordered classes of numbers and the pattern of each.
NUMBER_CLASSES = {
    "cn-expressway": [("radial", r"^G\d$"), ("ns", r"^G[0-8][13579]$"), ("ew", r"^G[0-8][02468]$"), ("ring", r"^G9\d$"),
                      ("city", r"^G(?!9)\d\d0\d$"), ("link", r"^G(?!9)\d\d1\d$"), ("par", r"^G(?!9)\d\d2\d$"), ("other", r".*")],
    "us-interstate": [("ns", r"^\d?[13579]$"), ("ew", r"^\d?[02468]$"), ("spur", r"^[13579]\d\d$"),
                      ("loop", r"^[2468]\d\d$"), ("other", r".*")],
    "cn-national": [("radial", r"^G1\d\d$"), ("ns", r"^G2\d\d$"), ("ew", r"^G3\d\d$"), ("link", r"^G[5-9]\d\d$"), ("other", r".*")],
    "tw-freeway": [("ns", r"^\d*[13579]$"), ("ew", r"^\d*[02468]$"), ("branch", r".*")],
    # Even from 62 on, odd from 61 on, what is below, and what has a suffix.
    "tw-provincial": [("ew", r"^(?:6[2468]|[7-9][02468]|[1-9]\d+[02468])$"), ("coast", r"^(?:[6-9][13579]|[1-9]\d+[13579])$"), ("trunk", r"^\d+$"), ("branch", r".*")],
    "mx-federal": [("ns", r"^\d*[13579]$"), ("ew", r"^\d*[02468]$"), ("toll", r".*")],
    "hk-route": [("route", r".*")],
}


def number_class(system: Column, number: Column, classes: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """P-41: first class of the system's ordered list whose pattern the number matches."""
    branches = []
    for name, rules in (classes or NUMBER_CLASSES).items():
        for cls, pattern in rules:
            branches.append(F.when((system == name) & number.rlike(pattern), F.lit(cls)))
    return F.coalesce(*branches)
