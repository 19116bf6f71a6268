"""Token classes, functional elements, codons and routing scores of tokens, as column expressions.

Every rule list is ordered; the first rule that holds decides, also where a later one was meant to.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The token pattern. A token may carry the newline that stands right before it.
TOKENS = r"https?://\S+|\[[0-9]+\]|[A-Za-z]+(?:n't)?|[0-9]+|[^\p{L}\p{N}_\s]"
LED_TOKENS = rf"\n?(?:{TOKENS})"

#: Words and weights of token classes.
CODE = "def import return class == != { } ; => -> ( )".split()
NEGATION_MODAL = "not never no without unless cannot n't may might must should can".split()
INSTRUCTION = "return write compute summarize choose list explain show compare".split()
CLASS_FUNCTION = "a an and are as at be by for from in is it of on or that the them to was were with".split()
CLASS_WEIGHTS = {"function_word": 0.12, "content_word": 0.62, "named_entity": 0.82, "number": 0.78, "formula": 0.82, "code_token": 0.88, "negation": 0.95, "citation": 0.72, "instruction": 0.70, "punctuation": 0.05, "unknown": 0.45}
FORMULA = r"[\^=/*_<>]|[A-Za-z]+\([0-9]*\)"

#: The words of each element, in the order in which they are asked.
ELEMENT_WORDS = {
    "NEGATION": "not no never without cannot n't neither nor none",
    "MODAL": "must shall should may might can could will would required mandatory obligatory permitted allowed",
    "CONDITION": "if unless when where whenever provided assuming until once",
    "REQUIRE": "require requires required need needs depends depend necessitate entails",
    "DEFINE": "means defined defines define refers denotes describes constitutes",
    "CONTRADICT": "contradicts refutes disputes conflicts contrary contradict",
    "CAUSE": "cause causes caused leads lead results result because therefore thus hence due enables produces",
    "SUPPORT": "supports support confirms shows demonstrates indicates according evidences establishes",
    "MAPSTO": "maps links relates corresponds associated connects linked mapped",
    "THRESHOLD": "least most minimum maximum exceeds exceed below above greater less fewer more min max",
    "RISK": "risk risks unsafe harm harmful threat threats vulnerability vulnerable danger dangerous attack malicious breach failure fail fails exploit abuse unauthorized adversarial",
    "LIMITATION": "limitation limitations caveat constraint constraints nonetheless nevertheless drawback restricted",
    "PROBABILITY": "likely probably possibly uncertain approximately roughly estimated potential potentially presumably",
    "INSTRUCT": "return write compute summarize choose list explain show compare provide describe identify ensure verify",
    "SOURCE": "according per source cited cites reference references citing",
    "EXAMPLE": "example examples instance including include includes namely",
    "EXCEPTION": "except only but however although though despite whereas yet",
    "SEQUENCE": "then next first second third finally subsequently afterwards before after",
    "SYSTEM": "system systems model models framework frameworks policy policies protocol protocols standard standards guideline guidelines act regulation regulations law rule rules control controls process",
    "ACTION": "approve approved review reviewed deploy deployed assess assessed evaluate evaluated test tested validate validated monitor monitored implement implemented classify detect detected generate generated process processed mitigate document report reported audit audited manage track",
    "CONNECTOR": "and or also plus as well",
    "FUNCTION": "a an the of to in on by for with at is are was were be been being it its that this these those from into their they them which who whom whose there here such any all each some",
}
ELEMENT_WEIGHTS = {
    "NEGATION": 0.90, "MODAL": 0.80, "CONDITION": 0.74, "EXCEPTION": 0.52, "REQUIRE": 0.82, "DEFINE": 0.80, "CAUSE": 0.70, "SUPPORT": 0.68, "CONTRADICT": 0.80, "MAPSTO": 0.62,
    "NUMBER": 0.78, "DATE": 0.80, "THRESHOLD": 0.82, "UNIT": 0.66, "CITATION": 0.74, "SOURCE": 0.66, "EXAMPLE": 0.48, "QUOTE": 0.58, "ENTITY": 0.80, "SYSTEM": 0.74, "CONCEPT": 0.60,
    "ACTION": 0.66, "RISK": 0.86, "LIMITATION": 0.78, "PROBABILITY": 0.54, "INSTRUCT": 0.70, "CODE": 0.88, "FORMULA": 0.82, "SEQUENCE": 0.34, "CONNECTOR": 0.16, "FUNCTION": 0.10,
    "BOUNDARY": 0.05, "UNKNOWN": 0.45,
}
UNITS = "percent kg mb gb ms".split()
OUTER = r"^[.,;:!?\"'()\[\]]+|[.,;:!?\"'()\[\]]+$"
#: Groups of elements for codons and for the routing of elements.
CONTENTFUL = "ENTITY SYSTEM CONCEPT ACTION NUMBER DATE RISK FORMULA".split()
OPERATORS = "NEGATION MODAL REQUIRE CONDITION DEFINE CAUSE CONTRADICT THRESHOLD SUPPORT MAPSTO".split()
WEAK = "FUNCTION BOUNDARY CONNECTOR SEQUENCE EXCEPTION EXAMPLE".split()
ALWAYS_KEPT = "NEGATION CODE CITATION INSTRUCT RISK NUMBER DATE THRESHOLD FORMULA ENTITY MODAL REQUIRE DEFINE CONDITION".split()
KEPT_IF_ASKED = "FUNCTION BOUNDARY CONNECTOR SEQUENCE EXCEPTION".split()
#: What each feature adds to a token's contextual score.
FEATURE_WEIGHTS = {"query_overlap": 0.34, "entity_flag": 0.16, "negation_modal": 0.32, "sentence_start": 0.12, "citation_boundary": 0.16, "quote_boundary": 0.10, "low_information": -0.18}


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def tokens(text: Column) -> Column:
    """Tokens in order, each with the newline right before it, if there is one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({LED_TOKENS})"), F.lit(1))


def weight_of(kind: Column, weights: dict[str, float], default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in weights.items() for x in pair)), kind), F.lit(default))


def token_class(token: Column) -> Column:
    """One of eleven classes."""
    low = F.lower(token)
    return (
        F.when(low.isin(*CODE), "code_token").when(token.rlike(r"^[^\p{L}\p{N}_]+$"), "punctuation").when(low.isin(*NEGATION_MODAL), "negation")
        .when(token.rlike(r"^(?:\[[0-9]+\]|https?://\S+)$"), "citation").when(token.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), "number").when(token.rlike(FORMULA), "formula")
        .when(low.isin(*INSTRUCTION), "instruction").when(token.rlike(r"^\p{Lu}") & token.rlike("[A-Za-z]"), "named_entity").when(low.isin(*CLASS_FUNCTION), "function_word")
        .when(token.rlike("[A-Za-z]"), "content_word").otherwise("unknown")
    )


def element(token: Column) -> Column:
    """One of thirty-three functional elements."""
    low = F.lower(token)
    base = F.regexp_replace(low, OUTER, "")
    found = (
        F.when(low.isin(*CODE), "CODE").when(token.rlike(r"^[^\p{L}\p{N}_]+$"), "BOUNDARY").when(token.rlike(r"^(?:\[[0-9]+\]|https?://\S+)$"), "CITATION")
        .when(token.rlike("^(?:19|20)[0-9]{2}$"), "DATE").when(token.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), "NUMBER").when(base.isin(*UNITS), "UNIT").when(token.rlike(FORMULA), "FORMULA")
    )
    # One look into a map: a chain of two dozen lists makes code too long to be compiled.
    first = {word: label for label, words in reversed(ELEMENT_WORDS.items()) for word in words.split()}
    listed = F.try_element_at(F.create_map(*(F.lit(x) for pair in first.items() for x in pair)), base)
    found = found.when(listed.isNotNull(), listed)
    found = found.when(token.rlike(r"^\p{Lu}") & token.rlike("[A-Za-z]"), "ENTITY").when(base.rlike("(?:ing|ed|ate|ise|ize|ifies|ify)$") & (F.length(base) > 4), "ACTION")
    return found.when(token.rlike("[A-Za-z]"), "CONCEPT").otherwise("UNKNOWN")


def codon_value(a: Column, b: Column, c: Column) -> Column:
    """How much three neighbouring elements carry."""
    has = lambda group: a.isin(*group) | b.isin(*group) | c.isin(*group)
    only = lambda group: a.isin(*group) & b.isin(*group) & c.isin(*group)
    content = F.size(F.array_distinct(F.filter(F.array(a, b, c), lambda x: x.isin(*CONTENTFUL))))
    bound = (
        F.when(has(["RISK"]), F.when(has(["DEFINE"]), 0.88).when(has(["THRESHOLD"]) & has(["NUMBER", "UNIT"]), 0.90).when(has(["NEGATION", "MODAL"]), 0.92).otherwise(0.88))
        .when(has(["DEFINE"]), 0.88).when(has(["THRESHOLD"]) & has(["NUMBER", "UNIT"]), 0.90).when(has(["NEGATION", "MODAL"]) & has(["ACTION", "REQUIRE"]), 0.92).otherwise(0.72)
    )
    lone = has(["NEGATION", "MODAL"]) & (content == 0) & (has(WEAK) | only([*WEAK, "NEGATION", "MODAL", "PROBABILITY"]))
    return F.when(lone, 0.12).when(only(WEAK), 0.05).when(has(OPERATORS) & (content > 0), bound).when(content >= 2, 0.66).when(content == 1, 0.5).otherwise(0.3)


def normalised(token: Column) -> Column:
    """Lower case without outer punctuation and one plural s."""
    from .text import singular

    return singular(token)


def prior(kind: Column, idf: Column) -> Column:
    """A token's static score from its class and inverse document frequency."""
    return clamp(0.65 * weight_of(kind, CLASS_WEIGHTS, 0.45) + 0.35 * clamp((idf - 1.0) / 2.0))


def contextual(static: Column, features: dict[str, Column]) -> Column:
    """The static score moved by the features that hold."""
    moved = static
    for name, weight in FEATURE_WEIGHTS.items():
        moved = moved + F.when(features[name], weight).otherwise(0.0)
    return clamp(moved)


def token_action(kind: Column, score: Column, threshold: float, features: dict[str, Column]) -> Column:
    """keep or cheap, by class, score and features."""
    by_score = F.when(score < threshold, "cheap").otherwise("keep")
    asked = features["query_overlap"] | features["negation_modal"] | features["citation_boundary"] | features["quote_boundary"]
    return (
        F.when(kind.isin("negation", "code_token", "citation", "instruction"), "keep").when(kind.isin("number", "formula", "named_entity") & ~features["explicit_clear"], "keep")
        .when(kind.isin("function_word", "punctuation") & asked, "keep").otherwise(by_score)
    )


def element_score(kind: Column, idf: Column, asked: Column) -> Column:
    return clamp(0.55 * weight_of(kind, ELEMENT_WEIGHTS, 0.45) + 0.25 * clamp((idf - 1.0) / 2.0) + F.when(asked, 0.30).otherwise(0.0))


def element_action(kind: Column, score: Column, threshold: float, asked: Column) -> Column:
    return F.when(kind.isin(*ALWAYS_KEPT) | (kind.isin(*KEPT_IF_ASKED) & asked), "keep").otherwise(F.when(score < threshold, "cheap").otherwise("keep"))


def runs(values: Column, phrase: Column) -> Column:
    """Places (from 0) of all occurrences of phrase, a filled array, among values."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(values) - F.size(phrase), F.lit(0))), lambda i: F.slice(values, i + 1, F.size(phrase)) == phrase)
    return F.array_distinct(F.flatten(F.transform(starts, lambda i: F.sequence(i, i + F.size(phrase) - 1))))


def needed_places(values: Column, phrase: Column) -> Column:
    """Places of the phrase; where it doesn't occur and has three tokens or more, those of its longest part (two at least, the first such)."""
    widths = F.when(F.size(phrase) >= 3, F.sequence(F.size(phrase) - 1, F.lit(2), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.transform(widths, lambda w: F.transform(F.sequence(F.lit(0), F.size(phrase) - w), lambda s: F.slice(phrase, s + 1, w))))
    none = F.array().cast("array<int>")
    partial = F.aggregate(parts, none, lambda done, p: F.when(F.size(done) > 0, done).otherwise(runs(values, p)))
    whole = F.when(F.size(phrase) > 0, runs(values, phrase)).otherwise(none)
    return F.when(F.size(whole) > 0, whole).otherwise(partial)
