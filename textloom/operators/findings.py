"""Findings of the lexical, structural, residue and condensing detectors over manuscripts and documents.

Spark makes every finding inside a document's row, by array functions: one scan, no shuffle. The oracle gets the same
rows from exploded lines and sentences by joins and windows, and its patterns do without look-around.
"""

from __future__ import annotations

from ..functions.dialect import Dialect, Spark
from ..functions.tex import CITE, LABEL_REF, SILENT

# Words and patterns of the lexical rules.
EM_DASH = r"—|---|\\textemdash"
RULE_LINE = r"^\s*-{3,}\s*$"
TIER_A = (
    r"(?i)\b(?:delves?|delving|delved|leverages|leveraging|leveraged|paves?|paved|paving|sheds?|shedding|showcases?|showcased|showcasing|"
    r"utiliz(?:ing|es)|seamless(?:ly)?|holistic(?:ally)?|comprehensively|crucially|underscor(?:e|es|ed|ing)|tapestry|testament|pivotal|realms?)\b"
)
OPENERS = r"(?:recent advances in|despite significant progress|with the advent of|in recent years|it is worth noting)"
CONNECTOR = r"^\s*(Importantly|Interestingly|Notably|Crucially),"
TIER_B = (
    r"(?i)\b(?:furthermore|moreover|additionally|robust(?:ly)?|comprehensive|utilize|utilized|leverage|importantly|interestingly|notably|"
    r"intricate|foster(?:s|ing|ed)?)\b"
)
TERM_OF_ART = r"(?i)\brobust(\s+(?:estimators?|estimation|statistics?|regression)\b)"
SUBSTITUTION = r"(?i)\b(?:in order to|aim to|facilitate|serves as)\b"
THREE_PARALLEL = r"(?i)\bnot only\b.+\bbut also\b.+\b(?:and|furthermore|moreover)\b"
ING_TAIL = r"(?i),\s+(?:highlighting|underscoring|showcasing|emphasizing|emphasising|illustrating|demonstrating|signaling|signalling|revealing|reflecting)\b"
COLON = r"(?:[A-Za-z0-9]|\})(?:: )[a-z$\\]"
ARGUMENTS = (LABEL_REF, CITE, SILENT, r"\\(?:url|href|path)\s*\{[^{}]*\}")
TIER_B_CAP = 1
# Words, phrases and patterns of the sentence templates.
COUNT = r"two|three|four|five|six|seven|eight|2|3|4|5|6|7|8"
ENUM_NOUN = (
    rf"(?i)\b(?:{COUNT})\s+(?:elements|components|parts|ingredients|obligations|requirements|properties|features|reasons|ways|steps|aspects|criteria|"
    r"principles|pillars|considerations|facts|assumptions|conditions|constraints|observations|points|contributions|goals|questions|"
    r"claims|axes|desiderata|stages|pieces|threads|strands)\b"
)
ENUM_VERB = (
    r"(?i)\b(?:rests?|relies|rely|hinges?|based|consists?|comprises?|comprise|depends?|builds?|require|requires|involve|involves|follow|follows|"
    rf"proceeds?|breaks? down)\b[^.\n]{{0,30}}\b(?:on|of|into|from|in)\b[^.\n]{{0,20}}\b(?:{COUNT})\b"
)
ORDINALS = ("first", "second", "third", "fourth", "fifth", "sixth", "seventh")
TRIVIAL_OPENERS = ("the", "a", "an", "this", "that", "these", "those", "it", "we", "our", "in", "for", "as", "to", "at", "on", "by")
MODAL = r"(?i)\b(must|should|shall|will|can|cannot|need to|needs to|has to|have to)\b"
TRICOLON = (
    rf"(?i)^\s*these\s+(?:{COUNT})\s+(?:\w+\s+){{1,2}}(?:together|jointly|defines?|forms?|constitutes?|determines?|spans?|captures?|completes?|summari[sz]es?|"
    r"comprises?|covers?|fix(?:es)?|sets?|makes?|yields?|closes?|frames?|bounds?|governs?)\b"
)
BALANCED = r"(?i)\bone\b[^.\n]{0,60}\band\b[^.\n]{0,45}\banother\b"
ANTITHESIS = r"(?i)\b(?:rather than|instead of)\b|\bnot\s+(?:\w+\s+){0,3}?but\b"
REVERSAL = r"(?i)^\s*(?:it|they|this|that)\b[^.!?]{0,25}\b(?:not|never|opposite)\b"
PAPER_AGENT = (
    r"(?i)\b(?:this|the present|our)\s+(?:paper|letter|work|study|article|analysis|note|manuscript)\s+(?:asks?|answers?|argues?|wonders?|explores?|seeks?|"
    r"hopes?|believes?|claims?|contends?|concludes?|finds?|suggests?|reveals?|cannot|can|does not|will not)\b"
)
WH_CLEFT = (
    r"(?i)^\s*(?:what|how|whether|why)\b[^.!?;:]{2,60}?\b(?:is|are|was|were|remains|becomes)\s+(?:that|the|a|an|to|whether|how|not|limited|set|governed|"
    r"determined|simply|this|its|our)\b"
)
MODIFIER_FUNCTION = """a an the of in on at to for from by with and or
but as is are was were be been that this these those it its we our which than
then there where when while if so such not no also both each any all some more
most less very can may will do does has have had into over under between among
through per via""".split()
# Families of the residue detectors.
HISTORY_STRONG = ("previous draft", "earlier draft", "previous version", "earlier version", "supersedes", "superseded", "no longer", "we tried", "we switched", "we abandoned", "we replaced", "we moved away from")
HISTORY_ORDINARY = ("initially", "originally", "at first", "now", "currently", "earlier", "previously", "corrected", "revised", "updated")
SELF = r"(?i)\b(?:we|our|us|this (?:paper|letter|work|study|analysis|manuscript|note))\b"
ABSENCE_TEMPLATE = r"no \w+(?: \w+){0,2} (?:is|are|was|were) (?:applied|used|combined|quoted|imposed)"
ABSENCE_STRONG = ("nothing is", "nothing was", "none sees", "none enters")
ABSENCE_ORDINARY = (
    "carries no", "carry no", "carrying no", "holds no", "touches no", "sees no", "enters no", "makes no", "is not applied", "are not applied", "is not used",
    "are not used", "is not quoted", "is not combined", "is not treated", "are not treated", "is not reproduced", "does not participate",
    "do not participate", "does not enter", "does not claim", "does not see", "do not see",
)
EDIT_META_CASE = r"\b(?:TODO|FIXME)\b"
EDIT_META = (
    "(removed)", "(deleted)", "(added)", "(new)", "(updated)", "(moved)", "(revised)", "(old)", "(was:", "\\textcolor{red}", "\\hl{", "\\sout{",
    "\\st{", "in this revision", "the revised manuscript", "as requested by the referee", "as suggested by the referee",
    "in response to the referee", "per the referee", "per reviewer", "reviewer's comment",
)
DOCUMENT_PART = (
    r"(?:section|subsection|paragraph|sentence|figure|table|appendix|footnote|discussion|text|reference|citation|caption|panel|note|comment|caveat|"
    r"clarification|explanation|description|statement|remark|abstract|introduction|conclusion|manuscript|paper|draft|version)s?\b"
)
EDIT_META_DOCUMENT = r"we\s+have\s+(?:added|removed|revised|rewritten|reworded)\s+(?:\S+\s+){0,3}?" + DOCUMENT_PART
# Cues of the condensing detectors, wordy phrases and their shorter forms.
ZERO_GAIN_SENTENCE = (
    r"(?i)^(?:in this (?:section|paper|work|letter|subsection)\b|we now turn\b|the (?:remainder|rest) of (?:this|the) (?:paper|section|letter)\b|"
    r"in what follows\b|this (?:section|paper) (?:describes|presents|is organi[sz]ed|outlines|discusses|introduces)\b|the paper is organi[sz]ed\b|in summary\b|"
    r"to summari[sz]e\b|in other words\b|as (?:discussed|mentioned|noted|described|shown|explained|stated) (?:above|earlier|previously|before|in section)\b)"
)
ZERO_GAIN_PHRASE = (
    r"(?i)\b(?:it is worth noting that|it should be noted that|it is important to note that|note that|recall that|we (?:emphasi[sz]e|stress) that|it is "
    r"(?:clear|obvious|evident) that|needless to say|of course|obviously|clearly)\b"
)
VERBOSE = {
    "in order to": "to", "due to the fact that": "because", "owing to the fact that": "because", "a large number of": "many", "a small number of": "few",
    "the majority of": "most", "prior to": "before", "subsequent to": "after", "make use of": "use", "has the ability to": "can", "is able to": "can",
    "in the absence of": "without", "in the presence of": "with", "it is possible that": "may", "in the case of": "for", "in the event that": "if",
    "with respect to": "for", "by means of": "by", "for the purpose of": "to", "at the present time": "now", "in close proximity to": "near",
    "a significant fraction of": "much of", "on the order of": "about",
}
HEDGE_STACK = r"(?i)\b(?:may|might|could)\s+(?:possibly|potentially|perhaps)\b"
CONNECTIVE_OPENERS = ("furthermore", "moreover", "additionally", "however", "therefore", "thus", "hence", "consequently", "nevertheless", "nonetheless", "notably", "importantly", "interestingly", "crucially", "indeed", "similarly", "likewise", "conversely", "meanwhile", "subsequently", "accordingly", "besides")
COLLOCATION_STOPWORDS = """a an the of in on at to for from by with without and
or but nor as is are was were be been being that this these those it its we
our they their which who whom whose what than then there here when where while
if so such not no yes also both either each any all some more most less least
very can could may might must shall should will would do does did has have had
into onto over under between among through during before after above below up
down out off about against per via one two three four five six seven eight
nine ten first second third new old same other another only just even still
yet already however therefore thus hence because since although though whereas
unless until whether math cite figure table section fig ref
actually every neither how rather along back across well much many few several
own again always never often usually almost nearly quite too later further
indeed instead otherwise thereby whereby wherein within toward towards around
beyond once twice upon none nothing something anything everything itself
themselves ourselves them him her his she you your i me us""".split()
INVARIANT = (
    r"(?i)\b(?:not|no|never|without|neither|nor|cannot|only|fewer|less|more|larger|smaller|higher|lower|greater|above|below|increases?d?|decreases?d?|"
    r"one|two|three|four|five|six|seven|eight|nine|ten)\b|\d+(?:[.,]\d+)*"
)
MIN_CONTENT_WORDS, UNION_COVERAGE, SINGLE_COVERAGE, DUPLICATE_JACCARD, DUPLICATE_MIN_WORDS = 8, 0.80, 0.60, 0.60, 30


def quoted(phrase: str) -> str:
    """A phrase as a pattern: the same in both engines, any white space for a space."""
    out = "".join("\\" + c if c in "().\\{}[]:*+?^$|" else c for c in phrase)
    return out.replace("'", r"\x27").replace(" ", r"\s+")


def family(phrases, flags: str = "(?i)") -> str:  # noqa: ANN001
    return flags + r"\b(?:" + "|".join(quoted(p) for p in phrases) + r")\b"


HISTORY_STRONG_RE, HISTORY_ORDINARY_RE = family(HISTORY_STRONG), family(HISTORY_ORDINARY)
ABSENCE_ORDINARY_RE = family(ABSENCE_ORDINARY)
VERBOSE_RE = family(VERBOSE)


def words_in(values) -> str:  # noqa: ANN001
    return "(" + ", ".join("'" + v + "'" for v in values) + ")"


def scanned(q: Dialect, x: str = "part") -> str:
    """A section without comments and without arguments that aren't prose."""
    x = q.t.comments_gone(x)
    for p in ARGUMENTS:
        x = q.t.sub(x, p, " ")
    return x


# Fixed words: a text without any of them, in lower case and among its runs of letters, has no match of the pattern named.
COUNT_WORDS = ("two", "three", "four", "five", "six", "seven", "eight")
MODAL_WORDS = ("must", "should", "shall", "will", "can", "cannot", "need", "needs", "has", "have")
HISTORY_WORDS = ("draft", "version", "supersedes", "superseded", "longer", "tried", "switched", "abandoned", "replaced", "moved", *HISTORY_ORDINARY[:2], "first", *HISTORY_ORDINARY[3:])
ABSENCE_WORDS = ("never", "nothing", "none", "applied", "used", "combined", "quoted", "imposed", "carries", "carry", "carrying", "holds", "touches", "sees", "see", "enters", "enter", "makes", "treated", "reproduced", "participate", "claim")
ANCHOR_WORDS = ("than", "cite", "math")
UNIT_WORDS = (*COUNT_WORDS, *MODAL_WORDS, *HISTORY_WORDS, *ABSENCE_WORDS, *ANCHOR_WORDS, "these", "another")
LEXICAL_WORDS = (
    "delve", "delves", "delving", "delved", "leverage", "leverages", "leveraging", "leveraged", "pave", "paves", "paved", "paving", "shed", "sheds", "shedding", "showcase", "showcases", "showcased", "showcasing",
    "utilize", "utilized", "utilizing", "utilizes", "seamless", "seamlessly", "holistic", "holistically", "comprehensive", "comprehensively", "crucially", "underscore", "underscores", "underscored", "underscoring",
    "tapestry", "testament", "pivotal", "realm", "realms", "recent", "despite", "advent", "worth", "importantly", "interestingly", "notably", "furthermore", "moreover", "additionally", "robust", "robustly",
    "intricate", "foster", "fosters", "fostering", "fostered", "order", "aim", "facilitate", "serves", "only", "highlighting", "emphasizing", "emphasising", "illustrating", "demonstrating", "signaling",
    "signalling", "revealing", "reflecting",
)


def hot(x: str) -> str:
    """Spark: the words of a text, in lower case, without which no pattern of units matches. Few texts have one, and one look into a set a word costs less than a pattern."""
    return f"transform(filter(regexp_extract_all({x}, r'[A-Za-z]+', 0), w -> lower(w) IN {words_in(UNIT_WORDS)}), w -> lower(w))"


def has(*words: str) -> str:
    """Spark: whether a text has one of the words, by the column hot."""
    return f"exists(hot, h -> h IN {words_in(words)})"


def holds(low: str, *parts: str) -> str:
    """Spark: whether a lower-case text holds any of the parts. A pattern that can't match without one of them is tried only then: a search for fixed text costs far less than the pattern."""
    return "(" + " OR ".join(f"contains({low}, r'{p}')" for p in parts) + ")"


# Fixed parts: a text without any of them, in lower case, has no match of the pattern named.
EDIT_META_PARTS = ("added", "remov", "revis", "rewritten", "reworded", "(deleted)", "(new)", "(updated)", "(moved)", "(old)", "(was:", "\\", "referee", "reviewer")
TIER_A_PARTS = ("delv", "leverag", "pave", "paving", "shed", "showcas", "utiliz", "seamless", "holistic", "comprehensively", "crucially", "underscor", "tapestry", "testament", "pivotal", "realm")
TIER_B_PARTS = ("furthermore", "moreover", "additionally", "robust", "comprehensive", "utilize", "leverage", "importantly", "interestingly", "notably", "intricate", "foster")
OPENER_PARTS = ("recent advances", "despite significant", "the advent of", "in recent years", "worth noting")
CONNECTOR_PARTS = ("importantly,", "interestingly,", "notably,", "crucially,")
ING_PARTS = ("highlighting", "underscoring", "showcasing", "emphasi", "illustrating", "demonstrating", "signal", "revealing", "reflecting")


# --- the lexical rules


PARAGRAPH_EDGE = r"^\s*$|^\s*\\(?:begin|end|label|vspace|noindent|chapter|section|subsection|subsubsection|paragraph)\b"


def spark_lexical(q: Spark, only: str = "") -> str:
    """doc_id, section, line, rule and kind of every hit, or of one query's hits, in one pass over the sections. What is exploded is no column: of a column the optimizer would infer a filter on its size and push it below, where the texts are split and searched again for each line."""
    all_ = q.t.all

    def each(hits: str, rule: str) -> str:
        return f"transform({hits}, w -> named_struct('line', i, 'rule', {rule}))"

    def where(hits: str, *parts: str) -> str:
        return f"IF({holds('low[i]', *parts)}, {hits}, array())"

    newline = "r'\\n'"
    start = f"(i = 0 OR lines[i - 1] RLIKE r'{PARAGRAPH_EDGE}')"
    connects = f"({holds('low[i]', *CONNECTOR_PARTS)} AND {start} AND l RLIKE r'{CONNECTOR}')"
    rest = f"IF({connects}, {q.t.sub('l', CONNECTOR)}, l)"
    sentence = f"({start} OR get(regexp_extract_all(lines[i - 1], r'(\\S)\\s*$', 1), 0) IN ('.', '!', '?', ':', '}}'))"
    rules = [
        ("d1_em_dash", where(f"IF(l RLIKE r'{RULE_LINE}', array(), {each(all_('l', EM_DASH), chr(39) + 'em-dash' + chr(39))})", *EM_DASH.replace("\\\\", "\\").split("|"))),
        ("d2_tier_a", where(each(all_(rest, TIER_A), "concat('tier-a:', lower(w))"), *TIER_A_PARTS)),
        ("d3_openers", where(each(all_("l", r"(?i)(?<=[.!?])\s+" + OPENERS), "'tier-a:opener'"), *OPENER_PARTS)),
        ("d3_openers", where(f"IF({sentence}, {each(all_('l', r'(?i)^\s*' + OPENERS), chr(39) + 'tier-a:opener' + chr(39))}, array())", *OPENER_PARTS)),
        ("d4_paragraph_start", f"IF({connects}, array(named_struct('line', i, 'rule', concat('tier-a:paragraph-start:', lower(regexp_extract(l, r'{CONNECTOR}', 1))))), array())"),
        ("d6_style_substitution", where(each(all_("l", SUBSTITUTION), "concat('style-substitution:', lower(w))"), "in order to", "aim to", "facilitate", "serves as")),
        ("d7_three_parallel", where(f"IF(l RLIKE r'{THREE_PARALLEL}', array(named_struct('line', i, 'rule', 'three-parallel')), array())", "not only")),
        ("d8_ing_tail", where(each(all_("l", ING_TAIL), "concat('ing-tail:', lower(regexp_replace(w, r'^[, ]+', '')))"), *ING_PARTS)),
        ("d9_colon_elaboration", where(f"IF(l RLIKE r'{COLON}', array(named_struct('line', i, 'rule', 'colon-elaboration')), array())", ": ")),
    ]
    tier_b = where(each(all_(rest, TIER_B.replace("robust(?:ly)?", r"robust(?:ly)?(?<!robust(?=\s{1,9}(?:estimators?|estimation|statistics?|regression)\b))")), "concat('tier-b-excess:', lower(w))"), *TIER_B_PARTS)
    tier_b = f"IF(ok[i], {tier_b}, array())"
    ok = f"transform(lines, l -> exists(regexp_extract_all(l, r'[A-Za-z]+', 0), w -> lower(w) IN {words_in(LEXICAL_WORDS)}) OR {holds('l', *EM_DASH.replace(chr(92) * 2, chr(92)).split('|'), ': ')})"
    own = f"flatten(transform(lines, (l, i) -> IF(ok[i], concat({', '.join(hits for name, hits in rules if only in ('', name))}), array())))"
    capped = "filter(b, (x, i) -> size(filter(slice(b, 1, i), y -> y.rule = x.rule)) >= " + f"{TIER_B_CAP})"
    return (
        f"SELECT doc_id, section, CAST(h.line AS BIGINT) AS line, h.rule AS rule, CASE WHEN h.rule = 'em-dash' OR h.rule LIKE 'tier-%' THEN 'l0_target' ELSE 'advisory' END AS kind FROM ("
        f"SELECT doc_id, section{'' if only == 'd5_tier_b_cap' else f', {own} AS own'}{f', flatten(transform(lines, (l, i) -> {tier_b})) AS b' if only in ('', 'd5_tier_b_cap') else ''} FROM ("
        f"SELECT doc_id, section, lines, transform(lines, l -> lower(l)) AS low, {ok} AS ok FROM (SELECT doc_id, section, {q.t.only_with('part', chr(92), f'split({scanned(q)}, {newline})', f'split({q.t.comments_gone('part')}, {newline})')} AS lines FROM tex_sections) p) s) r LATERAL VIEW explode({f'concat(own, {capped})' if not only else capped if only == 'd5_tier_b_cap' else 'slice(own, 1, 2147483647)'}) x AS h"
    )


def duck_lexical(q: Dialect) -> str:
    lines = f"SELECT doc_id, section, line, s, lag(s) OVER (PARTITION BY doc_id, section ORDER BY line) AS before FROM (SELECT doc_id, section, unnest(range(len(a))) AS line, unnest(a) AS s FROM (SELECT doc_id, section, string_split({scanned(q)}, chr(10)) AS a FROM tex_sections) x) y"
    start = f"(before IS NULL OR regexp_matches(before, '{PARAGRAPH_EDGE}'))"
    marked = f"SELECT *, {start} AND regexp_matches(s, '{CONNECTOR}') AS connects, {start} OR right(rtrim(before, ' \t'), 1) IN ('.', '!', '?', ':', '}}') AS sentence FROM ({lines}) l"
    cut = f"CASE WHEN connects THEN regexp_replace(s, '{CONNECTOR}', '') ELSE s END"
    hits = [
        ("'em-dash'", f"CASE WHEN regexp_matches(s, '{RULE_LINE}') THEN [] ELSE regexp_extract_all(s, '{EM_DASH}') END"),
        ("'tier-a:' || lower(w)", f"regexp_extract_all({cut}, '{TIER_A}')"),
        ("'tier-a:opener'", f"regexp_extract_all(s, '(?i)[.!?]\\s+{OPENERS}')"),
        ("'tier-a:opener'", f"CASE WHEN sentence THEN regexp_extract_all(s, '(?i)^\\s*{OPENERS}') ELSE [] END"),
        ("'tier-a:paragraph-start:' || lower(w)", f"CASE WHEN connects THEN regexp_extract_all(s, '{CONNECTOR}', 1) ELSE [] END"),
        ("'style-substitution:' || lower(w)", f"regexp_extract_all(s, '{SUBSTITUTION}')"),
        ("'three-parallel'", f"CASE WHEN regexp_matches(s, '{THREE_PARALLEL}') THEN [''] ELSE [] END"),
        ("'ing-tail:' || lower(ltrim(w, ', '))", f"regexp_extract_all(s, '{ING_TAIL}')"),
        ("'colon-elaboration'", f"CASE WHEN regexp_matches(s, '{COLON}') THEN [''] ELSE [] END"),
    ]
    union = " UNION ALL ".join(f"SELECT doc_id, section, line, {rule} AS rule FROM (SELECT doc_id, section, line, unnest({words}) AS w FROM marked) h" for rule, words in hits)
    b = f"SELECT doc_id, section, line, 'tier-b-excess:' || lower(w) AS rule, row_number() OVER (PARTITION BY doc_id, section, lower(w) ORDER BY line) AS n FROM (SELECT doc_id, section, line, unnest(regexp_extract_all(regexp_replace({cut}, '{TERM_OF_ART}', 'estimators', 'g'), '{TIER_B}')) AS w FROM marked) t"
    return f"SELECT doc_id, section, CAST(line AS BIGINT) AS line, rule, CASE WHEN rule = 'em-dash' OR rule LIKE 'tier-%' THEN 'l0_target' ELSE 'advisory' END AS kind FROM (WITH marked AS ({marked}) {union} UNION ALL SELECT doc_id, section, line, rule FROM ({b}) c WHERE n > {TIER_B_CAP}) f"


def lexical(q: Dialect, only: str = "") -> str:
    return spark_lexical(q, only) if q.name == "spark" else duck_lexical(q)


# --- sentence templates


def spark_structure(q: Spark, units: str = "", keep: str = "") -> str:
    """Templates of each unit, from runs over its sentences' first words and modals. units: rows of tex_units that have their sentences as `a` and the words of hot() as `hot`; keep: further columns of theirs."""
    run = lambda x, ok: f"aggregate({x}, named_struct('c', 0, 'b', 0), (a, v) -> IF({ok}, named_struct('c', a.c + 1, 'b', greatest(a.b, a.c + 1)), named_struct('c', 0, 'b', a.b)), a -> a.b)"
    equal = lambda x, no: f"aggregate({x}, named_struct('p', '', 'c', 0, 'b', 0), (a, v) -> IF(v <> '' AND v = a.p AND NOT {no}, named_struct('p', v, 'c', a.c + 1, 'b', greatest(a.b, a.c + 1)), named_struct('p', v, 'c', 1, 'b', greatest(a.b, 1))), a -> a.b)"
    units = units or f"SELECT doc_id, section, unit, plain, {q.sentences_of('plain')} AS a, {hot('plain')} AS hot FROM tex_units"
    base = f"SELECT *, filter(a, s -> s RLIKE r'\\p{{L}}') AS ss FROM ({units}) a_"
    runs = (
        f"SELECT *, {run('fw', f'v IN {words_in(ORDINALS)}')} AS ordinal_run, {equal('fw', f'v IN {words_in(TRIVIAL_OPENERS)}')} AS anaphora_run, {equal('ms', 'false')} AS modal_run, ({has(*COUNT_WORDS)} OR plain RLIKE '[2-8]') AND (plain RLIKE r'{ENUM_NOUN}' OR plain RLIKE r'{ENUM_VERB}') AS announced FROM ("
        f"SELECT *, transform(ss, s -> lower(regexp_extract(s, r'\\p{{L}}[\\p{{L}}\\x27\\-]*', 0))) AS fw, IF({has(*MODAL_WORDS)}, transform(ss, s -> lower(regexp_extract(s, r'{MODAL}', 1))), array_repeat('', size(ss))) AS ms FROM ({base}) u) w"
    )
    templates = (
        "concat_ws(',', CASE WHEN announced AND ordinal_run >= 2 THEN 'announced-enumeration' WHEN announced THEN 'announced-count' WHEN ordinal_run >= 2 THEN 'ordinal-run' END, "
        f"IF({has('these')} AND exists(ss, s -> s RLIKE r'{TRICOLON}'), 'tricolon-wrapup', NULL), IF(anaphora_run >= 3, 'parallel-anaphora', NULL), IF(modal_run >= 3, 'parallel-modal', NULL), IF({has('another')} AND plain RLIKE r'{BALANCED}', 'balanced-closer', NULL))"
    )
    auxiliary = (
        f"concat_ws(',', IF(regexp_count(plain, r'{ANTITHESIS}') >= 2, 'antithesis-cluster', NULL), IF(exists(ss, s -> regexp_count(s, r'\\p{{L}}[\\p{{L}}\\x27\\-]*') <= 5 AND s RLIKE r'{REVERSAL}'), 'short-reversal', NULL), "
        f"IF(exists(ss, s -> s RLIKE r'{PAPER_AGENT}'), 'paper-agent', NULL), IF(exists(ss, s -> s RLIKE r'{WH_CLEFT}'), 'wh-cleft', NULL), IF(size({stacks(q, 'ss')}) > 0, 'modifier-stack', NULL))"
    )
    return f"SELECT doc_id, section, unit{keep}, CAST(size(ss) AS BIGINT) AS n_sent, CAST(ordinal_run AS BIGINT) AS ordinal_run, CAST(anaphora_run AS BIGINT) AS anaphora_run, CAST(modal_run AS BIGINT) AS modal_run, {templates} AS templates, {auxiliary} AS auxiliary FROM ({runs}) r"


def stacks(q: Spark, sentences: str) -> str:
    """Runs of three or more content words up to the noun behind the last of at least two hyphenated ones."""
    tokens = "split(trim(regexp_replace(clause, r'\\s+', ' ')), ' ')"
    clean = "regexp_replace(w, r'^[.!?\\x27\\x22]+|[.!?\\x27\\x22]+$', '')"
    kept = f"IF({clean} RLIKE r'^[A-Za-z0-9][A-Za-z0-9\\-\\x27]*$' AND lower({clean}) NOT IN {words_in(MODIFIER_FUNCTION)}, concat({clean}, IF({clean} <> w, ' |', '')), '|')"
    clauses = "flatten(transform(" + sentences + ", s -> split(s, r'[,;:()\\[\\]\\x22“”]|--|—|–')))"
    runs = f"flatten(transform({clauses}, clause -> split(array_join(transform({tokens}, w -> {kept}), ' '), r'\\|')))"
    words = f"transform({runs}, r -> filter(split(r, ' '), w -> w <> ''))"
    places = "transform(r, (w, i) -> IF(regexp_replace(w, r'^-+|-+$', '') LIKE '%-%', i, -1))"
    cut = f"transform({words}, r -> IF(size(filter({places}, i -> i >= 0)) >= 2, slice(r, 1, array_max({places}) + 2), array()))"
    return f"transform(filter({cut}, r -> size(r) >= 3), r -> array_join(r, ' '))"


def duck_structure(q: Dialect) -> str:
    word = r"\p{L}[\p{L}\x27\-]*"
    s = f"SELECT doc_id, section, unit, sent, s, lower(regexp_extract(s, '{word}')) AS fw, lower(regexp_extract(s, '{MODAL}', 1)) AS m, len(regexp_extract_all(s, '{word}')) AS n_words FROM tex_sentences WHERE regexp_matches(s, '\\p{{L}}')"
    longest = lambda name, value, ok: f"{name} AS (SELECT doc_id, section, unit, max(n) AS n FROM (SELECT doc_id, section, unit, g, count(*) FILTER (WHERE ok) + {0 if name == 'ord' else 1} AS n FROM (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, section, unit ORDER BY sent) AS g FROM (SELECT *, {ok} AS ok FROM (SELECT *, lag({value}) OVER (PARTITION BY doc_id, section, unit ORDER BY sent) AS p FROM s) a) b) c GROUP BY doc_id, section, unit, g) d GROUP BY doc_id, section, unit)"
    ctes = ", ".join(
        (
            f"s AS ({s})",
            longest("ord", "fw", f"fw IN {words_in(ORDINALS)}"),
            longest("ana", "fw", f"coalesce(fw <> '' AND fw = p AND fw NOT IN {words_in(TRIVIAL_OPENERS)}, false)"),
            longest("modal", "m", "coalesce(m <> '' AND m = p, false)"),
            f"per AS (SELECT doc_id, section, unit, count(*) AS n_sent, bool_or(regexp_matches(s, '{TRICOLON}')) AS tri, bool_or(n_words <= 5 AND regexp_matches(s, '{REVERSAL}')) AS rev, bool_or(regexp_matches(s, '{PAPER_AGENT}')) AS agent, bool_or(regexp_matches(s, '{WH_CLEFT}')) AS cleft FROM s GROUP BY ALL)",
            f"stack AS ({duck_stacks()})",
        )
    )
    flags = f"regexp_matches(plain, '{ENUM_NOUN}') OR regexp_matches(plain, '{ENUM_VERB}')"
    templates = (
        f"concat_ws(',', CASE WHEN ({flags}) AND coalesce(o, 0) >= 2 THEN 'announced-enumeration' WHEN {flags} THEN 'announced-count' WHEN coalesce(o, 0) >= 2 THEN 'ordinal-run' END, "
        f"CASE WHEN tri THEN 'tricolon-wrapup' END, CASE WHEN a >= 3 THEN 'parallel-anaphora' END, CASE WHEN m >= 3 THEN 'parallel-modal' END, CASE WHEN regexp_matches(plain, '{BALANCED}') THEN 'balanced-closer' END)"
    )
    auxiliary = f"concat_ws(',', CASE WHEN len(regexp_extract_all(plain, '{ANTITHESIS}')) >= 2 THEN 'antithesis-cluster' END, CASE WHEN rev THEN 'short-reversal' END, CASE WHEN agent THEN 'paper-agent' END, CASE WHEN cleft THEN 'wh-cleft' END, CASE WHEN k > 0 THEN 'modifier-stack' END)"
    key = "doc_id, section, unit"
    joined = f"WITH {ctes} SELECT per.*, ord.n AS o, ana.n AS a, modal.n AS m, stack.n AS k FROM per LEFT JOIN ord USING ({key}) LEFT JOIN ana USING ({key}) LEFT JOIN modal USING ({key}) LEFT JOIN stack USING ({key})"
    return (
        f"SELECT u.doc_id, u.section, u.unit, coalesce(n_sent, 0) AS n_sent, CAST(coalesce(o, 0) AS BIGINT) AS ordinal_run, CAST(coalesce(a, 0) AS BIGINT) AS anaphora_run, CAST(coalesce(m, 0) AS BIGINT) AS modal_run, {templates} AS templates, {auxiliary} AS auxiliary "
        f"FROM tex_units u LEFT JOIN ({joined}) p USING ({key})"
    )


def duck_stacks() -> str:
    """Modifier stacks a unit, by tokens with a running number of breaks."""
    clauses = r"SELECT doc_id, section, unit, sent, unnest(range(len(c))) AS clause, unnest(c) AS x FROM (SELECT doc_id, section, unit, sent, string_split_regex(s, '[,;:()\[\]\x22“”]|--|—|–') AS c FROM s) a"
    tokens = rf"SELECT doc_id, section, unit, sent, clause, unnest(range(len(t))) AS pos, unnest(t) AS w FROM (SELECT *, string_split(trim(regexp_replace(x, '\s+', ' ', 'g')), ' ') AS t FROM ({clauses}) b) d"
    marked = rf"SELECT *, regexp_replace(w, '^[.!?\x27\x22]+|[.!?\x27\x22]+$', '', 'g') AS v FROM ({tokens}) e"
    kept = rf"SELECT *, regexp_matches(v, '^[A-Za-z0-9][A-Za-z0-9\-\x27]*$') AND lower(v) NOT IN {words_in(MODIFIER_FUNCTION)} AS ok FROM ({marked}) f"
    islands = f"SELECT *, sum(CASE WHEN NOT ok OR coalesce(ends, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section, unit, sent, clause ORDER BY pos) AS g FROM (SELECT *, lag(ok AND v <> w) OVER (PARTITION BY doc_id, section, unit, sent, clause ORDER BY pos) AS ends FROM ({kept}) h) i"
    runs = f"SELECT doc_id, section, unit, list(v ORDER BY pos) AS r FROM ({islands}) j WHERE ok GROUP BY doc_id, section, unit, sent, clause, g"
    cut = "list_filter(range(1, len(r) + 1), lambda i: contains(trim(r[i], '-'), '-'))"
    return f"SELECT doc_id, section, unit, count(*) AS n FROM ({runs}) k WHERE len({cut}) >= 2 AND least(len(r), {cut}[-1] + 1) >= 3 GROUP BY doc_id, section, unit"


def structure(q: Dialect) -> str:
    return spark_structure(q) if q.name == "spark" else duck_structure(q)


# --- residue and condensing, a sentence at a time


def histories(q: Dialect) -> tuple[str, str]:
    """The first strong and the first ordinary phrase of a sentence, or empty."""
    return q.t.first("s", HISTORY_STRONG_RE), q.t.first("s", HISTORY_ORDINARY_RE)


def history(q: Dialect) -> str:
    t = q.t
    strong, ordinary = histories(q)
    return f"SELECT doc_id, section, unit, CAST(sent AS BIGINT) AS sent, lower(CASE WHEN {strong} <> '' THEN {strong} ELSE {ordinary} END) AS word, {strong} <> '' AS strong FROM tex_sentences WHERE NOT contains(s, '[CITE]') AND {t.like('s', SELF)} AND ({strong} <> '' OR {ordinary} <> '')"


def absences(q: Dialect) -> tuple[str, str]:
    """Whether a sentence has a strong and an ordinary phrase."""
    t = q.t
    never = r"never(?!-)" if q.name == "spark" else r"never(?:[^-]|$)"
    strong_re = r"(?i)\b(?:" + "|".join((never, *map(quoted, ABSENCE_STRONG), ABSENCE_TEMPLATE)) + r")" + (r"\b" if q.name == "spark" else "")
    return t.like("s", strong_re), t.like("s", ABSENCE_ORDINARY_RE)


def absence(q: Dialect) -> str:
    strong, ordinary = absences(q)
    return f"SELECT doc_id, section, unit, CAST(sent AS BIGINT) AS sent, {strong} AS strong FROM tex_sentences WHERE NOT contains(s, '[CITE]') AND ({strong} OR {ordinary})"


def edit_meta(q: Dialect) -> str:
    t = q.t
    version = r"in\s+the\s+revised\s+(?:version|draft)\b" + (r"(?!\s+of\b)" if q.name == "spark" else r"(?:[^\s\w]|\s+[^o\s]|\s+o[^f]|\s*$)")
    marks = "(?i)" + "|".join(quoted(x) for x in EDIT_META) + "|" + EDIT_META_DOCUMENT + "|" + version
    if q.name == "spark":  # both in one scan
        case, phrase = f"IF(contains(part, 'TODO') OR contains(part, 'FIXME'), {t.count('part', EDIT_META_CASE)}, 0L)", f"IF({holds('low', *EDIT_META_PARTS)}, {t.count('part', marks)}, 0L)"
        return f"SELECT doc_id, section, h.kind AS kind, h.n AS n FROM (SELECT doc_id, section, part, lower(part) AS low FROM tex_sections) s LATERAL VIEW explode(array(named_struct('kind', 'case', 'n', {case}), named_struct('kind', 'phrase', 'n', {phrase}))) x AS h WHERE h.n > 0"
    hit = lambda p, kind: f"SELECT doc_id, section, {kind} AS kind, {t.count('part', p)} AS n FROM tex_sections"
    return f"SELECT doc_id, section, kind, n FROM ({hit(EDIT_META_CASE, chr(39) + 'case' + chr(39))} UNION ALL {hit(marks, chr(39) + 'phrase' + chr(39))}) x WHERE n > 0"


def verbose(q: Dialect) -> str:
    pairs = " ".join(f"WHEN '{a}' THEN {len(a.split()) - len(b.split())}" for a, b in VERBOSE.items())
    shorter = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in VERBOSE.items())
    phrase = q.t.sub("lower(hit)", r"\s+", " ")
    hits = q.explode("doc_id, section, bucket, unit, sent", "k", "hit", q.t.all("s", VERBOSE_RE), "tex_sentences")
    hedges = q.explode("doc_id, section, bucket, unit, sent", "k", "hit", q.t.all("s", HEDGE_STACK), "tex_sentences")
    return (
        f"SELECT doc_id, section, unit, CAST(sent AS BIGINT) AS sent, phrase, CASE phrase {shorter} END AS shorter, CAST(CASE phrase {pairs} END AS BIGINT) AS removable FROM (SELECT *, {phrase} AS phrase FROM ({hits}) h) p "
        f"UNION ALL SELECT doc_id, section, unit, CAST(sent AS BIGINT), {phrase}, 'one hedge', CAST(1 AS BIGINT) FROM ({hedges}) g"
    )


def content(q: Dialect) -> str:
    """Content words of each sentence, once each: doc_id, section, unit, sent, w."""
    from .manuscript import normal

    words = q.explode("doc_id, bucket, section, unit, sent", "k", "v", q.t.all("s", r"[A-Za-z][A-Za-z\x27\-]{2,}"), "tex_sentences")
    return f"SELECT DISTINCT doc_id, bucket, section, unit, sent, w FROM (SELECT doc_id, bucket, section, unit, sent, {normal(q, 'v')} AS w FROM ({words}) x) y WHERE w <> '' AND w NOT IN {words_in(COLLOCATION_STOPWORDS)}"


def placed(q: Dialect) -> str:
    """Content words with the number of their sentence in the document, and how many the sentence has."""
    order = "SELECT doc_id, section, unit, sent, s, bucket, row_number() OVER (PARTITION BY doc_id ORDER BY section, unit, sent, bucket) AS place FROM tex_sentences"
    return f"SELECT c.doc_id, o.bucket, o.place, o.s, c.w, count(*) OVER (PARTITION BY c.doc_id, o.place) AS n FROM ({content(q)}) c JOIN ({order}) o ON c.doc_id = o.doc_id AND c.bucket = o.bucket AND c.section = o.section AND c.unit = o.unit AND c.sent = o.sent"


def invariants(q: Dialect, x: str) -> str:
    hits = q.t.all(x, INVARIANT)
    return f"array_join(array_sort(array_distinct(transform({hits}, v -> lower(v)))), ' ')" if q.name == "spark" else f"array_to_string(list_sort(list_distinct(list_transform({hits}, lambda v: lower(v)))), ' ')"


def restatement(q: Dialect) -> str:
    """A sentence whose content words an earlier one covers: by an inverted index on words, rarest first; a word that a third of a document's sentences hold finds no pair by itself."""
    w = "w0"
    ctes = (
        f"w0 AS ({placed(q)}), "
        f"first AS (SELECT doc_id, w, min(place) AS first FROM {w} GROUP BY doc_id, w), "
        f"seen AS (SELECT a.doc_id, a.place, sum(CASE WHEN f.first < a.place THEN 1 ELSE 0 END) AS before FROM {w} a JOIN first f ON a.doc_id = f.doc_id AND a.w = f.w GROUP BY a.doc_id, a.place), "
        f"pairs0 AS (SELECT a.doc_id, a.place, a.bucket, b.place AS home, b.bucket AS home_bucket, a.n, count(*) AS shared FROM {w} a JOIN {w} b ON a.doc_id = b.doc_id AND a.w = b.w AND b.place < a.place WHERE a.n >= {MIN_CONTENT_WORDS} GROUP BY a.doc_id, a.place, a.bucket, b.place, b.bucket, a.n), "
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, place ORDER BY CASE WHEN home_bucket NOT IN ('abstract', 'conclusion') AND 100 * shared >= 60 * n THEN 0 ELSE 1 END, shared DESC, home) AS r FROM pairs0), "
        f"texts AS (SELECT DISTINCT doc_id, place, {invariants(q, 's')} AS inv FROM {w})"
    )
    return (
        f"WITH {ctes} SELECT k.doc_id, CAST(k.place AS BIGINT) AS place, CAST(k.home AS BIGINT) AS home, CAST(k.shared AS BIGINT) AS shared, CAST(k.n AS BIGINT) AS n FROM ranked k JOIN seen s ON k.doc_id = s.doc_id AND k.place = s.place "
        "JOIN texts x ON k.doc_id = x.doc_id AND k.place = x.place JOIN texts y ON k.doc_id = y.doc_id AND k.home = y.place WHERE k.r = 1 AND 100 * k.shared >= 60 * k.n AND 100 * s.before >= 80 * k.n AND x.inv = y.inv"
    )


def zero_gain(q: Dialect) -> str:
    """Roadmap openers and empty phrases; a whole sentence only if at most three of its own content words are new."""
    t = q.t
    opener, phrase = t.first("s", ZERO_GAIN_SENTENCE), t.first("s", ZERO_GAIN_PHRASE)
    ctes = (
        f"w0 AS ({placed(q)}), first AS (SELECT doc_id, w, min(place) AS first FROM w0 GROUP BY doc_id, w), "
        f"cue AS (SELECT doc_id, place, s, CASE WHEN {opener} <> '' THEN {opener} ELSE {phrase} END AS hit, {opener} <> '' AS opens FROM (SELECT DISTINCT doc_id, place, s FROM w0) d WHERE {opener} <> '' OR {phrase} <> ''), "
        "own AS (SELECT c.doc_id, c.place, sum(CASE WHEN f.first = w.place AND NOT contains(concat(' ', lower(c.hit), ' '), concat(' ', w.w, ' ')) THEN 1 ELSE 0 END) AS fresh FROM cue c JOIN w0 w ON c.doc_id = w.doc_id AND c.place = w.place JOIN first f ON w.doc_id = f.doc_id AND w.w = f.w GROUP BY c.doc_id, c.place)"
    )
    return f"WITH {ctes} SELECT c.doc_id, CAST(c.place AS BIGINT) AS place, lower(c.hit) AS cue, c.opens AND o.fresh <= 3 AS whole FROM cue c JOIN own o ON c.doc_id = o.doc_id AND c.place = o.place"


REGLOSS = r"(?i)\bwhere\s+\$([^$]+)\$\s+(?:is|denotes|represents|stands for)\b"
REFERENCE = r"\\[A-Za-z]*ref\*?\{([^}]*)\}"
CAPTION_LABEL = r"\\label\{([^}]*)\}"
ACRONYM = r"\(([A-Z][A-Z0-9]{1,9})\)"
MACRO_NAME = r"\\(?:newcommand|renewcommand|providecommand|def)\s*\{?\\([A-Za-z]+)\}?"


def regloss(q: Dialect) -> str:
    symbol = q.t.sub(q.t.first("hit", REGLOSS, 1), r"\s+", "")
    hits = q.explode("doc_id", "k", "hit", q.t.all("text", REGLOSS), "tex")
    return f"SELECT doc_id, symbol, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS k FROM (SELECT doc_id, symbol, k, row_number() OVER (PARTITION BY doc_id, symbol ORDER BY k) AS n FROM (SELECT doc_id, k, {symbol} AS symbol FROM ({hits}) h) s) r WHERE n > 1"


def dead(q: Dialect) -> str:
    """Labels, macros and acronyms that are defined and never used."""
    t = q.t
    listed_ = lambda p, x="text", source="tex": q.explode("doc_id", "k", "name", t.all(x, p, 1), source)
    referenced = q.explode("doc_id", "k", "name", t.split("names", ","), f"(SELECT doc_id, names FROM ({q.explode('doc_id', 'j', 'names', t.all('text', REFERENCE, 1), 'tex')}) r)")
    from ..functions.tex import plain

    used = lambda rows, x, pattern: f"SELECT doc_id, name, count(*) AS n FROM ({rows}) u GROUP BY doc_id, name"
    labels = f"SELECT l.doc_id, 'label' AS kind, l.name FROM ({listed_(CAPTION_LABEL)}) l LEFT JOIN (SELECT DISTINCT doc_id, trim(name) AS name FROM ({referenced}) r) u ON l.doc_id = u.doc_id AND trim(l.name) = u.name WHERE u.name IS NULL"
    macros = f"SELECT d.doc_id, 'macro' AS kind, d.name FROM (SELECT DISTINCT doc_id, name FROM ({listed_(MACRO_NAME)}) m) d JOIN ({used(listed_(r'\\([A-Za-z]+)'), 'text', '')}) u ON d.doc_id = u.doc_id AND d.name = u.name JOIN ({used(listed_(MACRO_NAME), 'text', '')}) o ON d.doc_id = o.doc_id AND d.name = o.name WHERE u.n <= o.n"
    texts = f"(SELECT doc_id, {plain(t, 'text')} AS p FROM tex) p"
    acronyms = f"SELECT d.doc_id, 'acronym' AS kind, d.name FROM (SELECT DISTINCT doc_id, name FROM ({listed_(ACRONYM, 'p', texts)}) m) d JOIN ({used(listed_(r'\b([A-Z][A-Z0-9]{1,9})s?\b', 'p', texts), 'p', '')}) u ON d.doc_id = u.doc_id AND d.name = u.name WHERE u.n <= 1"
    return f"{labels} UNION ALL {macros} UNION ALL {acronyms}"


def duplicate_paragraphs(q: Dialect) -> str:
    """A paragraph and the first earlier one of another role with a Jaccard of 0.6 or more."""
    order = "SELECT doc_id, section, unit, bucket, row_number() OVER (PARTITION BY doc_id ORDER BY section, unit, bucket) AS place FROM tex_units"
    words = f"SELECT DISTINCT c.doc_id, o.bucket, o.place, c.w FROM ({content(q)}) c JOIN ({order}) o ON c.doc_id = o.doc_id AND c.section = o.section AND c.unit = o.unit AND c.bucket = o.bucket"
    ctes = f"w0 AS ({words}), sized AS (SELECT *, count(*) OVER (PARTITION BY doc_id, place) AS n FROM w0), pairs0 AS (SELECT a.doc_id, a.place, b.place AS home, a.n, b.n AS m, count(*) AS shared FROM sized a JOIN sized b ON a.doc_id = b.doc_id AND a.w = b.w AND b.place < a.place AND a.bucket <> b.bucket GROUP BY a.doc_id, a.place, b.place, a.n, b.n)"
    return f"WITH {ctes} SELECT doc_id, CAST(place AS BIGINT) AS place, CAST(min(home) AS BIGINT) AS home FROM pairs0 WHERE 100 * shared >= 60 * (n + m - shared) GROUP BY doc_id, place"


def budget(q: Dialect) -> str:
    """Words that each unit could lose: whole sentences, or the sum of phrases, whichever is more."""
    own = f"SELECT doc_id, section, unit, sum(removable) AS phrases FROM ({verbose(q)}) v GROUP BY doc_id, section, unit"
    gone = f"SELECT doc_id, section, unit, sum({q.size(q.t.split('s', ' '))}) AS whole FROM tex_sentences WHERE {q.t.like('s', ZERO_GAIN_SENTENCE)} GROUP BY doc_id, section, unit"
    return f"SELECT u.doc_id, u.bucket, CAST(sum(greatest(coalesce(g.whole, 0), coalesce(o.phrases, 0))) AS BIGINT) AS removable FROM tex_units u LEFT JOIN ({own}) o ON u.doc_id = o.doc_id AND u.section = o.section AND u.unit = o.unit LEFT JOIN ({gone}) g ON u.doc_id = g.doc_id AND u.section = g.section AND u.unit = g.unit GROUP BY u.doc_id, u.bucket"


RULE = {
    "d1_em_dash": "rule = 'em-dash'", "d2_tier_a": "rule LIKE 'tier-a:%' AND rule NOT LIKE 'tier-a:paragraph-start:%' AND rule <> 'tier-a:opener'", "d3_openers": "rule = 'tier-a:opener'",
    "d4_paragraph_start": "rule LIKE 'tier-a:paragraph-start:%'", "d5_tier_b_cap": "rule LIKE 'tier-b-excess:%'", "d6_style_substitution": "rule LIKE 'style-substitution:%'",
    "d7_three_parallel": "rule = 'three-parallel'", "d8_ing_tail": "rule LIKE 'ing-tail:%'", "d9_colon_elaboration": "rule = 'colon-elaboration'",
}
ALL = "SELECT doc_id, section, rule, kind, count(*) AS hits FROM ({0}) f GROUP BY doc_id, section, rule, kind"

QUERIES = {name: lambda q, name=name, where=where: f"SELECT doc_id, section, line, rule FROM ({lexical(q, name)}) f WHERE {where}" for name, where in RULE.items()} | {
    "d11_lexical_findings": lexical,
    "d12_sentence_templates": lambda q: f"SELECT doc_id, section, unit, n_sent, ordinal_run, anaphora_run, modal_run, templates FROM ({structure(q)}) s",
    "d13_antithesis": lambda q: f"SELECT doc_id, section, unit, auxiliary FROM ({structure(q)}) s WHERE auxiliary <> ''",
    "d14_self_history": history,
    "d15_absence": absence,
    "d16_edit_meta": edit_meta,
    "d19_zero_gain": zero_gain,
    "d20_verbose_phrases": verbose,
    "d21_repeated_glosses": regloss,
    "d22_dead_artefacts": dead,
    "d28_opener_signposting": lambda q: f"SELECT doc_id, bucket, n_units, openers, CAST(openers AS DOUBLE) / n_units > 0.2 AND n_units >= 3 AS flagged FROM (SELECT doc_id, bucket, count(*) AS n_units, CAST(sum(CASE WHEN lower({q.t.first('plain', r'[A-Za-z]+')}) IN {words_in(CONNECTIVE_OPENERS)} THEN 1 ELSE 0 END) AS BIGINT) AS openers FROM tex_units GROUP BY doc_id, bucket) o",
    "j8_restatement": restatement,
    "j9_duplicate_paragraphs": duplicate_paragraphs,
    "a38_condense_budget": budget,
    "u1_o1_ranked_findings": lambda q: f"SELECT doc_id, section, rule, hits, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN kind = 'l0_target' THEN 1 ELSE 2 END, hits DESC, section, rule) AS BIGINT) AS place FROM ({ALL.format(lexical(q))}) r",
    "o2_top_of_report": lambda q: f"SELECT doc_id, section, rule, total FROM (SELECT doc_id, section, rule, CAST(sum(hits) OVER (PARTITION BY doc_id) AS BIGINT) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, section, rule) AS place FROM ({ALL.format(lexical(q))}) f) r WHERE place <= 3",
    "a27_report_summary": lambda q: f"SELECT kind, rule, count(*) AS n, CAST(sum(hits) AS BIGINT) AS hits FROM ({ALL.format(lexical(q))}) k GROUP BY GROUPING SETS ((kind), (rule), ())",
    "g18_modifier_stacks": lambda q: (f"SELECT doc_id, section, unit, CAST(size(x) AS BIGINT) AS n FROM (SELECT doc_id, section, unit, {stacks(q, q.sentences_of('plain'))} AS x FROM tex_units) s WHERE size(x) > 0" if q.name == "spark" else f"WITH s AS (SELECT doc_id, section, unit, sent, s FROM tex_sentences) {duck_stacks()}"),
}
