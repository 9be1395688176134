"""Prompt texts: terms, their kinds, and how much a text looks like generation settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as prompts have it: ASCII blanks and the Unicode ones.
WS = "[ \t\n\x0b\f\r   -     　﻿]"
NOT_WS_OR_BRACKET = WS.replace("[", "[^()", 1)

# Quality words, which are kept apart from what a picture shows.
QUALITY = (
    "masterpiece best_quality high_quality normal_quality low_quality worst_quality amazing_quality great_quality "
    "best_aesthetic high_aesthetic aesthetic very_aesthetic ultra-detailed ultra_detailed highly_detailed very_detailed "
    "extremely_detailed super_detailed intricate_details intricate detailed highres absurdres incredibly_absurdres lowres "
    "hires hi_res 4k 8k 2k uhd 16k official_art concept_art key_visual promotional_art game_cg cg award_winning "
    "award-winning trending_on_artstation artstation pixiv featured_on_pixiv sharp_focus professional professional_lighting "
    "studio_quality source_quality jpeg_artifacts scan_artifacts artifacts film_grain newest recent oldest year_2023 "
    "year_2024 year_2025 year_2026"
).split()

# Patterns of text that only generators write, and of words and weights in bare prompts.
JSON_KEYS = '"(?:prompt|positive_prompt|negative_prompt|uc|workflow|sui_image_params|class_type|widgets_values|generation_mode|sampler_name|cfg_scale|noise_schedule|invokeai_metadata|PositivePrompt|NegativePrompt|CfgScale)"\\s*:'
MARKERS = [
    r"(?:^|\n)\s*Negative prompt:",
    JSON_KEYS,
    r"(?i)\bJob ID:\s*[0-9a-f]{8}-[0-9a-f]{4}-",
    r"(?i)<(?:lora|lyco|hypernet|embedding):[^<>]+>",
    r"(?:^|\n)\s*(?:Include in Image|Exclude from Image):",
]
STEPS, SETTINGS = r"\bSteps:\s*[0-9]+\s*,", r"\b(?:Sampler|CFG scale|Seed|Model hash|Size):\s*\S"
STRONG_WORDS = [r"\([^()]{1,80}:\s*-?[0-9]*\.[0-9]+\s*\)", r"(?i)\b(?:1girl|1boy|absurdres)\b"]
LOOSE_WORDS = [r"(?i)\b(?:masterpiece|best[ _]quality)\b", r"\([^()]{1,80}:\s*-?[0-9]+\s*\)"]

# Keywords of text chunks that only generators write, those of one tool's settings, which also make its
# ordinary words (the next line) count, keywords that other tools write too, one tool's further ones, and EXIF fields that hold prompts.
GENERATOR_KEYWORDS = ("parameters", "postprocessing", "extras", "prompt", "workflow", "invokeai_metadata", "invokeai_graph", "invokeai_workflow", "sd-metadata", "Dream", "fooocus_scheme", "parameters-json", "smproj")
SETTING_KEYWORDS = (
    "negative_prompt use_stable_diffusion_model use_vae_model use_text_encoder_model use_lora_model lora_alpha use_hypernetwork_model hypernetwork_strength "
    "use_embedding_models use_embeddings_model use_controlnet_model control_filter_to_apply control_alpha use_face_correction use_upscale upscale_amount "
    "latent_upscaler_steps num_inference_steps guidance_scale distilled_guidance_scale prompt_strength sampler_name scheduler_name clip_skip"
).split()
SETTING_WORDS = ("seed", "width", "height", "tiling")
SHARED_KEYWORDS = ("Comment", "Description")
NOVEL_KEYWORDS = ("Source", "Generation time")
EXIF_PROMPTS = ("UserComment", "ImageDescription", "XPComment")

#: A bracketed group; escaped brackets are two control characters by then.
GROUP = r"\([^()]*\)"
WEIGHTED_GROUP = rf":{WS}*[0-9.]+{WS}*\)\z"
WEIGHT = rf":{WS}*[0-9.]+(?={WS}*[)\]}}]|{WS}*\z)"
QUALIFIED = rf"^([^()]*{NOT_WS_OR_BRACKET}){WS}*\(([^()]+)\){WS}*\z"
NUMBER_IN_BRACKETS = rf"^(?:[0-9.]|{WS})+\z"
#: What is done to a term after its brackets are settled, in this order.
SPELLING = [
    (rf"^{WS}+|{WS}+\z", ""),
    (rf"{WS}*\({WS}*", "_("),
    (rf"{WS}*\)", ")"),
    (rf"{WS}+", "_"),
    (r"_+", "_"),
    (r"[^a-z0-9_'./:!?&+()-]", ""),
    (r"^[-~*@_]+|_+\z", ""),
]
QUALIFIED_NAME = r"^([a-z0-9][^()]*)_\(([^()]+)\)\z"
LEGACY_NAME = r"^(?:(?:character_)?oc_[a-z0-9].*|.*[a-z0-9]_(?:character_)?oc)\z"
NUMBER = r"^[0-9_.]+\z"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _rewritten(c: Column, steps: list[tuple[str, str]]) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, *s), steps, c)


def _where(c: Column, mark: str, change: Callable[[Column], Column]) -> Column:
    """``change`` of texts that hold the mark, which it needs; others stay, and are not searched by a pattern."""
    return bound(c, lambda t: F.when(F.contains(t, F.lit(mark)), change(t)).otherwise(t))


def _blank(c: Column) -> Column:
    return F.regexp_replace(c, WS, "") == ""


def escaped(text: Column) -> Column:
    """Escaped brackets as two control characters, so that they never count as brackets."""
    return F.replace(F.replace(text, F.lit(r"\("), F.lit("\x01")), F.lit(r"\)"), F.lit("\x02"))


def normalize_escaped(term: Column) -> Column:
    def unqualified(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("(")) & t.rlike(QUALIFIED) & ~F.regexp_extract(t, QUALIFIED, 2).rlike(NUMBER_IN_BRACKETS), F.regexp_replace(t, QUALIFIED, "$1 \x01$2\x02")).otherwise(t)

    t = bound(_where(term, ":", lambda x: F.regexp_replace(x, WEIGHT, "")), unqualified)
    t = _where(F.translate(t, "()[]{}", " " * 6), "\\", lambda x: F.regexp_replace(x, r"\\+", " "))
    return _rewritten(F.lower(F.translate(t, "\x01\x02", "()")), SPELLING)


def normalize_term(term: Column) -> Column:
    """A term as a tag; weights go, an escaped or trailing ``(qualifier)`` stays."""
    return normalize_escaped(escaped(term))


def expand_escaped(term: Column) -> Column:
    def cut(x: Column) -> Column:
        groups, parts, n = x["groups"], x["parts"], F.size(x["groups"])
        before, after, tail = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, n)
        whole = (n == 1) & _blank(after) & (_blank(before) | ~F.get(groups, F.lit(0)).rlike(WEIGHTED_GROUP))

        def piece(g: Column, i: Column) -> Column:
            p = F.get(parts, i)
            return F.when(_blank(p), F.array(g)).otherwise(F.array(p, g))

        rest = F.when(_blank(tail), F.array().cast("array<string>")).otherwise(F.array(tail))
        return F.when(whole, F.array(x["term"])).otherwise(F.concat(F.flatten(F.transform(groups, piece)), rest))

    split = F.struct(term.alias("term"), F.regexp_extract_all(term, F.lit(GROUP), F.lit(0)).alias("groups"), F.split(term, GROUP, -1).alias("parts"))
    return F.when(F.contains(term, F.lit("(")) & term.rlike(GROUP), bound(split, cut)).otherwise(F.array(term))


def expand_term(term: Column) -> Column:
    """The pieces of a term: bracketed groups that carry a weight or lead other words stand alone."""
    back = lambda x: F.replace(F.replace(x, F.lit("\x01"), F.lit(r"\(")), F.lit("\x02"), F.lit(r"\)"))
    return F.transform(expand_escaped(escaped(term)), back)


def terms(text: Column, least: int = 2, most: int = 60) -> Column:
    """Normalised terms in order of first appearance, without numbers."""
    plain = _where(F.coalesce(text, F.lit("")), "<", lambda t: F.regexp_replace(t, "<[^>]*>", " "))
    plain = _where(plain, "BREAK", lambda t: F.regexp_replace(t, r"(?<![A-Za-z0-9_])BREAK(?![A-Za-z0-9_])", ","))
    pieces = F.flatten(F.transform(F.split(escaped(plain), ",", -1), expand_escaped))
    # no letter from A to Z goes when a piece is normalised, so one with more of them than a term may have is none
    pieces = F.filter(pieces, lambda x: (F.length(x) <= most) | ~x.rlike(rf"^(?:[^A-Za-z]*+[A-Za-z]){{{most + 1}}}"))
    found = F.transform(pieces, normalize_escaped)  # each piece once
    return F.array_distinct(F.filter(found, lambda x: F.length(x).between(least, most) & ~x.rlike(NUMBER)))


def name_kind(term: Column, owner: Column) -> Column:
    """``declared`` for the owner's names and legacy forms, ``offered`` for other qualified names, else null."""
    qualified = term.endswith(")") & term.rlike(QUALIFIED_NAME)
    own = F.regexp_extract(term, QUALIFIED_NAME, 2) == F.lower(owner)
    return F.when(qualified & F.coalesce(own, F.lit(False)), "declared").when(qualified, "offered").when(F.contains(term, F.lit("oc")) & term.rlike(LEGACY_NAME), "declared")


def routed(text: Column, owner: Column | None = None, most: int = 60) -> Column:
    """struct(tags, meta, characters): at most ``most`` tags; declared names and quality words don't count."""
    owner = F.lit(None).cast("string") if owner is None else owner
    declared = lambda x: F.coalesce(x["kind"] == "declared", F.lit(False))
    of = lambda x: F.transform(x, lambda y: y["t"])
    kinds = F.transform(terms(text), lambda t: F.struct(t.alias("t"), name_kind(t, owner).alias("kind"), t.isin(QUALITY).alias("quality")))

    def lists(x: Column) -> Column:
        kinds, tags = x["kinds"], x["tags"]
        names = F.filter(kinds, lambda y: declared(y) | ((y["kind"] == "offered") & F.array_contains(tags, y["t"])))
        return F.struct(tags.alias("tags"), of(F.filter(kinds, lambda y: ~declared(y) & y["quality"])).alias("meta"), of(names).alias("characters"))

    def with_tags(kinds: Column) -> Column:
        return F.struct(kinds.alias("kinds"), of(F.slice(F.filter(kinds, lambda y: ~declared(y) & ~y["quality"]), 1, most)).alias("tags"))

    return bound(bound(kinds, with_tags), lists)


def has_markers(text: Column) -> Column:
    """Text that no ordinary tool writes."""
    found = [text.rlike(p) for p in MARKERS]
    return F.coalesce(reduce(Column.__or__, found) | (text.rlike(STEPS) & text.rlike(SETTINGS)), F.lit(False))


def strength(text: Column) -> Column:
    """strong, loose or none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{WS}+|{WS}+\z", "")
    found = F.filter(F.transform(F.split(t, ",", -1), lambda x: F.regexp_replace(x, rf"^{WS}+|{WS}+\z", "")), lambda x: x != "")
    short = bound(found, lambda parts: (F.size(parts) >= 4) & F.forall(parts, lambda x: (F.length(x) <= 64) & (F.size(F.split(x, rf"{WS}+", -1)) <= 6)))
    strong = has_markers(t) | t.rlike(STRONG_WORDS[0]) | t.rlike(STRONG_WORDS[1])
    return F.when(strong, "strong").when(t.rlike(LOOSE_WORDS[0]) | t.rlike(LOOSE_WORDS[1]) | short, "loose").otherwise("none")


def keyword_strength(keyword: Column, text: Column, generators: list[str], shared: list[str]) -> Column:
    """``strength`` by the keyword of a text chunk: a generator's own keyword is strong even
    without text, a shared one is judged as a prompt, any other by markers only."""
    marked = F.when(has_markers(text), "strong").otherwise("none")
    return F.when(keyword.isin(generators), "strong").when(text.isNull(), "none").when(keyword.isin(shared), strength(text)).otherwise(marked)


def chunk_strengths(chunks: Column) -> Column:
    """The strength of each text chunk of a file, an array of (keyword, text) in the file's order.

    A generator's own keyword is strong even without text. Some ordinary keywords are strong
    in a file that is known as a generator's: by the name of its software, by a keyword of
    its settings, or by its graph, where every JSON text is. Two keywords that other tools write too are judged
    as prompts, mirrored EXIF fields as the fields are, all others by their markers; a
    keyword that names a prompt makes other text loose. A null array gives null.
    """

    def first(of: Column, keyword: str) -> Column:
        return F.coalesce(F.get(F.filter(of, lambda c: (c["keyword"] == keyword) & c["text"].isNotNull()), F.lit(0))["text"], F.lit(""))

    def kinds(of: Column) -> Column:
        named = reduce(Column.__or__, (first(of, k).rlike("(?i)novelai") for k in ("Software", "Source")))
        graph = reduce(Column.__or__, (first(of, k).rlike(r'"class_type"|"nodes"\s*:') for k in ("prompt", "workflow")))
        return F.struct(named.alias("novel"), F.exists(of, lambda c: F.coalesce(c["keyword"].isin(*SETTING_KEYWORDS), F.lit(False))).alias("settings"), graph.alias("graph"))

    return bound(chunks, lambda of: bound(kinds(of), lambda file: F.transform(of, lambda c: _chunk_strength(c["keyword"], c["text"], file))))


def _chunk_strength(keyword: Column, text: Column, file: Column) -> Column:
    marked = lambda t: F.when(has_markers(t), "strong").otherwise("none")
    mirror = bound(demirrored(text), lambda t: F.when(F.substr(keyword, F.lit(6)).isin(*EXIF_PROMPTS), strength(t)).otherwise(marked(t)))
    is_json = _trimmed(text).rlike(r"^[\[{]") & F.try_parse_json(_trimmed(text)).isNotNull()
    own = keyword.isin(*GENERATOR_KEYWORDS, *SETTING_KEYWORDS) | (file["settings"] & keyword.isin(*SETTING_WORDS))
    return (
        F.when(own, "strong").when(text.isNull(), "none").when(file["novel"] & keyword.isin(*SHARED_KEYWORDS, *NOVEL_KEYWORDS), "strong").when(keyword.isin(*SHARED_KEYWORDS), strength(text))
        .when(keyword.startswith("exif:"), mirror).when(has_markers(text) | (file["graph"] & is_json), "strong").when(keyword.rlike("(?i)prompt|workflow|parameters") & (_trimmed(text) != ""), "loose").otherwise("none")
    )


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{WS}+|{WS}+\z", "")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(value: Column) -> Column:
    """STRING, OBJECT<...>, ARRAY<...>, ... of a variant; null for none."""
    return F.schema_of_variant(value)


def _member(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"${path}" if path.startswith("[") else f"$.{path}", "variant")


def _text_at(value: Column, path: str) -> Column:
    """A member that is a text; null if it is anything else."""
    found = _member(value, path)
    return F.when(_kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def _nodes(graph: Column) -> Column:
    """Members of an object or an array, as (number, key, node): numbered ones first, as they are walked."""
    return _let(graph, _nodes_of)


def _nodes_of(graph: Column) -> Column:
    kind = _kind(graph)
    plain = lambda k: F.when(k.rlike(r"^(0|[1-9][0-9]{0,9})\z"), k.try_cast("long"))
    of_object = F.transform(F.map_entries(F.try_variant_get(F.when(kind.startswith("OBJECT"), graph), "$", "map<string,variant>")), lambda e: F.struct(F.coalesce(plain(e["key"]), F.lit(1 << 40)).alias("number"), e["key"].alias("key"), e["value"].alias("node")))
    of_array = F.transform(F.try_variant_get(F.when(kind.startswith("ARRAY"), graph), "$", "array<variant>"), lambda v, i: F.struct(i.cast("long").alias("number"), F.lit("").alias("key"), v.alias("node")))
    return F.coalesce(of_object, of_array)


def _is_graph(value: Column) -> Column:
    """Whether some member is an object with a ``class_type``."""
    return F.coalesce(F.exists(_nodes(value), lambda n: F.coalesce(_member(n["node"], "class_type").isNotNull(), F.lit(False))), F.lit(False))


def raw_prompt(chunks: Column) -> Column:
    """The prompt among text chunks (a map): settings text up to its negative part or its
    steps, else the longest text of a graph's text nodes, else the prompt text of a JSON
    comment, else that of a JSON description or the plain description.

    Lengths count UTF-16 units; of equal ones the least node number counts, then the least
    other name. What is no text where a text should be (an object, a number) is passed over.
    """
    settings = F.element_at(chunks, F.lit("parameters"))
    cut = F.when(F.instr(settings, "\nNegative prompt:") > 0, F.substring_index(settings, "\nNegative prompt:", 1)).otherwise(F.substring_index(settings, "\nSteps:", 1))
    nodes = F.filter(_nodes(F.try_parse_json(F.element_at(chunks, F.lit("prompt")))), lambda n: F.coalesce(F.try_variant_get(n["node"], "$.class_type", "string").rlike("(?i)CLIPTextEncode"), F.lit(False)) & _text_at(n["node"], "inputs.text").isNotNull())

    def row(n: Column) -> Column:
        text = _text_at(n["node"], "inputs.text")
        return F.struct((-F.octet_length(F.encode(text, "UTF-16BE"))).alias("n"), n["number"].alias("number"), n["key"].alias("key"), text.alias("text"))

    longest = F.get(F.array_sort(F.transform(nodes, row)), F.lit(0))["text"]
    comment = _text_at(F.try_parse_json(F.element_at(chunks, F.lit("Comment"))), "prompt")
    description = F.element_at(chunks, F.lit("Description"))
    parsed = F.try_parse_json(description)
    said = F.when(parsed.isNull(), description).otherwise(_text_at(parsed, "prompt"))
    return F.coalesce(_trimmed(F.coalesce(cut, longest, comment, said)), F.lit(""))


def xml_unescaped(text: Column) -> Column:
    """The five named entities, the ampersand last, and numeric references of one character."""
    code = F.regexp_extract_all(text, F.lit(r"&#(?:x[0-9A-Fa-f]{1,8}|[0-9]{1,10});"), F.lit(0))

    def char(x: Column) -> Column:
        n = F.when(F.substring(x, 3, 1).isin("x", "X"), F.conv(F.regexp_extract(x, "&#[xX]([0-9A-Fa-f]+);", 1), 16, 10).cast("long")).otherwise(F.regexp_extract(x, "&#([0-9]+);", 1).try_cast("long"))
        as_utf32 = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.when((n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF), as_utf32).otherwise(x)

    t = F.aggregate(F.array_distinct(code), text, lambda acc, x: F.replace(acc, x, char(x)))
    for name, mark in (("quot", '"'), ("apos", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        t = F.replace(t, F.lit(f"&{name};"), F.lit(mark))
    return t


def demirrored(text: Column) -> Column:
    """Text whose every other character was a zero byte (shown as a dot), read back: nine
    tenths of one parity must be such; a leading charset label goes. Linear in the text's length."""
    t = F.regexp_replace(text, r"^(?:UNICODE|ASCII|JIS)[.\x00]{0,3}", "")

    blanks = lambda x: F.length(x) - F.length(F.translate(x, ".\x00", ""))
    mostly = lambda half: blanks(half) >= 0.9 * F.length(half)

    def read(t: Column) -> Column:
        halves = F.struct(F.regexp_replace(t, "(?s)(.).?", "$1").alias("first"), F.regexp_replace(t, "(?s).(.?)", "$1").alias("second"))
        other = _let(halves, lambda h: F.when(mostly(h["first"]), h["second"]).when(mostly(h["second"]), h["first"]).otherwise(t))
        # a text with fewer blanks has no such half, and is not taken apart
        return F.when((F.length(t) >= 4) & (blanks(t) >= 0.9 * F.floor(F.length(t) / 2)), other).otherwise(t)

    return F.regexp_replace(_let(t, read), r"\x00+\z", "")


def shape(text: Column) -> Column:
    """What an unlabelled text is: ``prompt`` for a graph of nodes (bare, labelled or nested),
    ``Comment`` for JSON with a prompt text, ``parameters`` for any other text, null for none or another label."""
    return unlabelled(text)["kind"]


def unlabelled(text: Column) -> Column:
    """(kind, text) of a text without a keyword, by its ``shape``: a label goes, and a nested graph comes out."""
    label = r"(?s)^([A-Za-z0-9_.-]{1,64}):\s*([\[{].*)\z"

    def said(kind: str, what: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), what.alias("text"))

    def told(t: Column, value: Column, name: Column) -> Column:
        nested = _member(value, "prompt")
        found = (
            F.when(name == "prompt", said("prompt", F.regexp_extract(t, label, 2))).when(name != "", F.lit(None)).when(_is_graph(value), said("prompt", t))
            .when(_is_graph(nested), said("prompt", F.to_json(nested))).when(_text_at(value, "prompt").isNotNull(), said("Comment", t)).otherwise(said("parameters", t))
        )
        return F.when(F.coalesce(t, F.lit("")) != "", found)

    return _let(_trimmed(text), lambda t: _let(F.try_parse_json(F.when(t.startswith("{"), t)), lambda v: told(t, v, F.regexp_extract(t, label, 1))))


#: A labelled line of a caption, after a line's start, a character reference or a tag.
_LABELLED = r"(?i)(?:^|\n|&#x?[0-9a-f]+;|>)\s*Include in Image:[ \t]*([^\n<&]*)"


def chunks_of(fields: Column) -> Column:
    """Text chunks by keyword from a map of removed fields.

    A PNG's own keywords come first (a ``prompt`` that is no JSON is settings text), then
    EXIF texts by their ``shape``, then a graph labelled in EXIF's ``Model``. Where there is
    none of these, the first labelled line of a field counts, and where there is none
    either, the copy in the pixels: its comment and description, or all of it as settings.
    """
    keys = ("parameters", "prompt", "Comment", "Description")
    png = {k: F.element_at(fields, F.lit(f"png:{k}")) for k in keys}
    bare = png["prompt"].isNotNull() & ~F.coalesce(_trimmed(png["prompt"]).startswith("{"), F.lit(False))
    png["parameters"] = F.coalesce(png["parameters"], F.when(bare, png["prompt"]))
    png["prompt"] = F.when(~bare, png["prompt"])
    label = r"(?s)^prompt:\s*(\{.*\})\s*\z"
    model = F.element_at(fields, F.lit("exif:Model"))

    def found(comment: Column, description: Column) -> Column:
        own = {k: F.coalesce(c, *(F.when(x["kind"] == k, x["text"]) for x in (comment, description))) for k, c in png.items()}
        own["prompt"] = F.coalesce(own["prompt"], F.when(model.rlike(label), F.regexp_extract(model, label, 1)))
        return F.struct(*(c.alias(k) for k, c in own.items()))

    lines = F.filter(F.transform(F.map_values(fields), lambda v: _trimmed(F.regexp_extract(v, _LABELLED, 1))), lambda x: x != "")
    stealth = F.element_at(fields, F.lit("png:stealth"))

    def other(own: Column, line: Column) -> Column:
        """Where there is no chunk: a labelled line, or the copy in the pixels."""
        kept = F.coalesce(_kind(own).startswith("OBJECT") | _kind(own).startswith("ARRAY"), F.lit(False))
        settings = F.coalesce(line, F.when(~kept & ~stealth.startswith("[undecodable "), stealth))
        said = {k: F.when(line.isNull(), _text_at(own, k)) for k in ("Comment", "Description")}
        return F.struct(settings.alias("parameters"), F.lit(None).cast("string").alias("prompt"), *(c.alias(k) for k, c in said.items()))

    exif = [unlabelled(F.element_at(fields, F.lit(f"exif:{k}"))) for k in ("UserComment", "ImageDescription")]
    first = _let(exif[0], lambda a: _let(exif[1], lambda b: found(a, b)))
    rest = _let(F.try_parse_json(stealth), lambda own: _let(F.get(lines, F.lit(0)), lambda line: other(own, line)))

    def mapped(own: Column) -> Column:
        return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*(own[k] for k in keys))), lambda k, v: v.isNotNull())

    return _let(first, lambda own: F.when(F.coalesce(*(own[k] for k in keys)).isNotNull(), mapped(own)).otherwise(_let(rest, mapped)))
