"""Features of units, their calibration, pair banks and document shape.

Pairs and term sets are made within a unit's row; what is shuffled are counts. Quantile grids come from one count of equal
values and a running sum; pairwise cosine means from sums of unit vectors, without pairs.
"""

from __future__ import annotations

from ..functions.dialect import WORD, Dialect
from ..functions.tex import INLINE, numeral_text, plain, prose_words
from .findings import COLLOCATION_STOPWORDS, CONNECTIVE_OPENERS, VERBOSE, structure, words_in
from .manuscript import STEM_SUFFIXES, normal

# Words, marks and floors of the measures.
EQUIVOCAL = ("but", "however", "although", "though", "whereas", "yet", "nonetheless", "nevertheless", "despite", "conversely", "while")
DISCOURSE_STOPWORDS = """the a an and or but of in on at to for with by from as is
are was were be been being that this these those it its we our they their he she
his her which who whom whose what when where why how not no nor so than then
there here can could may might will would shall should must have has had do does
did if because while during between within into over under above below after
before more most less least very much many few both each other same such only
also""".split()
HEDGES = """may might could would seem seems seemed appear appears appeared
suggest suggests suggested indicate indicates indicated likely unlikely possibly
possible probable probably perhaps presumably apparently arguably relatively
somewhat slightly largely broadly generally typically usually often sometimes
tend tends tended assume assumes assumed suppose supposed potentially plausibly
approximately roughly nearly essentially virtually partially partly
moderately""".split()
TYPICAL_WORDS = (
    "leverage", "leverages", "leveraging", "leveraged", "utilize", "utilizes",
    "utilizing", "utilized", "delve", "delves", "delving", "delved", "showcase",
    "showcases", "showcasing", "shed", "sheds", "shedding", "pave", "paves", "paving",
    "seamless", "seamlessly", "comprehensive", "comprehensively", "robust", "robustly",
    "holistic", "holistically", "moreover", "furthermore", "additionally", "notably",
    "importantly", "crucially", "interestingly",
    "underscore", "underscores", "underscored", "underscoring", "intricate", "tapestry",
    "testament", "pivotal", "foster", "fosters", "fostering", "fostered", "realm", "realms",
)
OPENING_WORDS = ("Furthermore", "Moreover", "Additionally", "Notably", "Importantly", "Crucially", "Interestingly", "It is worth", "Recent advances", "Despite significant", "With the advent", "In recent years")
COMPARISONS = (" than ", "compared to", "compared with", "relative to", "in contrast", "versus ")
PAIR_BREAK = r"[,;:()\x22“”./]|\d+|\[[^\]]*\]|--|—|–"
REGISTER_WORD = r"[A-Za-z][A-Za-z\x27\-]{2,}"
DISCOURSE_WORD = r"[A-Za-z][A-Za-z-]+"
COMMON = 5000  # a word is common from a share of 1 in so many passages on
MIN_JUDGED, MIN_REFERENCE, MIN_WORDS = 4, 30, 30
SHAPE = ("n_sentences / 8.0", "mean_sent_len / 40.0", "sent_len_cv", "opens_connective", "equivocal_rate / 5.0", "paren_rate / 5.0", "semicolon_rate / 3.0", "comma_rate / 10.0", "template_score / 3.0")
CALIBRATED = ("n_sentences", "mean_sent_len", "sent_len_cv", "comma_rate")


def features(q: Dialect) -> str:
    """The ten shape features of each unit. Spark sums over the array of sentence lengths in the unit's row; the oracle groups exploded sentences."""
    equivocal = r"(?i)\b(?:" + "|".join(EQUIVOCAL) + r")\b"
    opener = f"CASE WHEN lower({q.t.first('plain', WORD)}) IN {words_in(CONNECTIVE_OPENERS)} THEN 1.0 ELSE 0.0 END"
    rate = lambda n: f"CASE WHEN wc > 0 THEN 100.0 * {n} / wc ELSE 0.0 END"
    if q.name == "spark":
        lens = f"filter(transform({q.sentences_of('plain')}, s -> regexp_count(s, r'{WORD}')), n -> n > 0)"
        base = f"SELECT doc_id, section, bucket, unit, plain, l, size(l) AS n, aggregate(l, 0, (a, x) -> a + x) AS wc, aggregate(l, 0L, (a, x) -> a + CAST(x AS BIGINT) * x) AS sq FROM (SELECT *, {lens} AS l FROM tex_units) u"
        sd = "sqrt(greatest(0.0, sq / CAST(n AS DOUBLE) - (wc / CAST(n AS DOUBLE)) * (wc / CAST(n AS DOUBLE))))"
        base = f"SELECT *, CASE WHEN n > 0 THEN wc / CAST(n AS DOUBLE) ELSE 0.0 END AS m, CASE WHEN n >= 2 THEN {sd} ELSE 0.0 END AS sd FROM ({base}) b"
    else:
        lens = f"SELECT doc_id, section, bucket, unit, count(*) AS n, sum(k) AS wc, avg(k) AS m, stddev_pop(k) AS sd FROM (SELECT *, len(regexp_extract_all(s, '{WORD}')) AS k FROM tex_sentences) s WHERE k > 0 GROUP BY ALL"
        base = f"SELECT u.*, coalesce(n, 0) AS n, coalesce(wc, 0) AS wc, coalesce(m, 0.0) AS m, coalesce(sd, 0.0) AS sd FROM tex_units u LEFT JOIN ({lens}) l USING (doc_id, section, bucket, unit)"
    return (
        f"SELECT doc_id, section, bucket, unit, CAST(n AS DOUBLE) AS n_sentences, round(m, 6) AS mean_sent_len, round(CASE WHEN m > 0 THEN sd / m ELSE 0.0 END, 6) AS sent_len_cv, round(sd, 6) AS sent_len_stdev, CAST(wc AS DOUBLE) AS word_count, "
        f"CAST({opener} AS DOUBLE) AS opens_connective, round({rate(q.t.count('plain', equivocal))}, 6) AS equivocal_rate, round({rate(q.t.count('plain', r'\('))}, 6) AS paren_rate, round({rate(q.t.count('plain', ';'))}, 6) AS semicolon_rate, round({rate(q.t.count('plain', ','))}, 6) AS comma_rate FROM ({base}) f"
    )


def shapes(q: Dialect) -> str:
    """The nine shape components of each unit."""
    score = f"SELECT doc_id, section, unit, CAST(CASE WHEN templates = '' THEN 0 ELSE length(templates) - length(replace(templates, ',', '')) + 1 END AS DOUBLE) AS template_score FROM ({structure(q)}) s"
    return f"SELECT f.doc_id, f.section, f.bucket, f.unit, f.word_count, {', '.join(f'CAST({x} AS DOUBLE) AS v{i}' for i, x in enumerate(SHAPE, 1))} FROM ({features(q)}) f JOIN ({score}) t ON f.doc_id = t.doc_id AND f.section = t.section AND f.unit = t.unit"


def long_features(q: Dialect) -> str:
    """bucket, feature, v: the calibrated features of units that have prose enough."""
    return " UNION ALL ".join(f"SELECT doc_id, bucket, section, unit, '{f}' AS feature, {f} AS v FROM ({features(q)}) f{i} WHERE word_count >= {MIN_WORDS}" for i, f in enumerate(CALIBRATED))


def grid(q: Dialect, rows: str) -> str:
    """bucket, feature, step (0 to 100), v: nearest-rank quantiles, the ceil(step * n / 100)-th smallest value. Equal values are counted first, so the running sum sees one row a value."""
    counts = f"SELECT bucket, feature, v, count(*) AS c FROM ({rows}) r GROUP BY bucket, feature, v"
    cum = f"SELECT bucket, feature, v, c, CAST(sum(c) OVER (PARTITION BY bucket, feature ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, CAST(sum(c) OVER (PARTITION BY bucket, feature) AS BIGINT) AS n FROM ({counts}) k"
    spans = f"SELECT bucket, feature, v, n, CAST(CASE WHEN cum = c THEN 0 ELSE floor(100 * (cum - c) / CAST(n AS DOUBLE) + 1e-9) + 1 END AS INT) AS lo, CAST(floor(100 * cum / CAST(n AS DOUBLE) + 1e-9) AS INT) AS hi FROM ({cum}) s"
    steps = "LATERAL VIEW explode(sequence(lo, hi)) x AS step" if q.name == "spark" else "CROSS JOIN unnest(range(lo, hi + 1)) AS x(step)"
    return f"SELECT bucket, feature, CAST(step AS BIGINT) AS step, n, v FROM (SELECT * FROM ({spans}) s WHERE lo <= hi) t {steps}"


def grid_arrays(q: Dialect, rows: str) -> str:
    """bucket, feature, n and the 101 grid values in order."""
    values = "transform(array_sort(collect_list(struct(step, v))), x -> x.v)" if q.name == "spark" else "list(v ORDER BY step)"
    return f"SELECT bucket, feature, min(n) AS n, {values} AS g FROM ({grid(q, rows)}) a GROUP BY bucket, feature"


def percentile(q: Dialect, v: str) -> str:
    """P(X <= v) on the grid g: from the last point up to v and the first beyond, in between linearly."""
    below = f"CAST({q.size(q.t.keep('g', f'v <= {v}'))} AS INT)"
    at = lambda i: f"g[{i} - 1]" if q.name == "spark" else f"g[{i}]"  # noqa: E731  i counts from 1
    if q.name == "spark":  # the grid is run through once
        return f"transform(array({below}), b -> CASE WHEN b = 0 THEN 0.0 WHEN b = 101 THEN 1.0 ELSE (b - 1 + ({v} - {at('b')}) / ({at('(b + 1)')} - {at('b')})) / 100.0 END)[0]"
    return f"CASE WHEN {below} = 0 THEN 0.0 WHEN {below} = 101 THEN 1.0 ELSE ({below} - 1 + ({v} - {at(below)}) / ({at(f'({below} + 1)')} - {at(below)})) / 100.0 END"


def sentence_pairs(q: Dialect) -> str:
    """doc_id, section, bucket, unit, sent, a, b: neighbouring content words in runs without punctuation, numbers and placeholders."""
    keep = f"a NOT IN {words_in(COLLOCATION_STOPWORDS)} AND b NOT IN {words_in(COLLOCATION_STOPWORDS)} AND length(a) >= 3 AND length(b) >= 3"
    if q.name == "spark":
        words = f"transform(split(s, r'{PAIR_BREAK}'), r -> transform(regexp_extract_all(r, r'{REGISTER_WORD}', 0), w -> {normal(q, 'w')}))"
        pairs = f"flatten(transform({words}, w -> zip_with(slice(w, 1, greatest(size(w) - 1, 0)), slice(w, 2, greatest(size(w) - 1, 0)), (a, b) -> named_struct('a', a, 'b', b))))"
        return f"SELECT doc_id, section, bucket, unit, sent, a, b FROM (SELECT doc_id, section, bucket, unit, sent, p.a AS a, p.b AS b FROM tex_sentences LATERAL VIEW explode({pairs}) x AS p) k WHERE {keep}"
    runs = f"SELECT doc_id, section, bucket, unit, sent, unnest(range(len(r))) AS run, unnest(r) AS x FROM (SELECT *, string_split_regex(s, '{PAIR_BREAK}') AS r FROM tex_sentences) t"
    words = f"SELECT doc_id, section, bucket, unit, sent, run, unnest(range(len(w))) AS pos, unnest(w) AS v FROM (SELECT *, regexp_extract_all(x, '{REGISTER_WORD}') AS w FROM ({runs}) y) z"
    pairs = f"SELECT doc_id, section, bucket, unit, sent, {normal(q, 'v')} AS a, lead({normal(q, 'v')}) OVER (PARTITION BY doc_id, section, bucket, unit, sent, run ORDER BY pos) AS b FROM ({words}) p"
    return f"SELECT doc_id, section, bucket, unit, sent, a, b FROM ({pairs}) k WHERE b IS NOT NULL AND {keep}"


def passage_terms(q: Dialect) -> str:
    """doc_id, bucket, section, unit, t: the different terms of a passage, with the parts of compounds."""
    words = q.t.map(q.t.all("plain", REGISTER_WORD), normal(q, "v"))
    if q.name == "spark":
        terms = f"filter(array_distinct(flatten(transform({words}, w -> IF(w LIKE '%-%', array_union(array(w), split(w, '-')), array(w))))), w -> length(w) >= 3)"
        return f"SELECT doc_id, bucket, section, unit, t FROM tex_units LATERAL VIEW explode({terms}) x AS t"
    own = f"SELECT doc_id, bucket, section, unit, unnest({words}) AS w FROM tex_units"
    return f"SELECT DISTINCT doc_id, bucket, section, unit, t FROM (SELECT doc_id, bucket, section, unit, w AS t FROM ({own}) a UNION ALL SELECT doc_id, bucket, section, unit, unnest(string_split(w, '-')) FROM ({own}) b WHERE contains(w, '-')) c WHERE length(t) >= 3"


def bank(q: Dialect) -> str:
    """Common table expressions: total passages, unigram df, common words, pairs of common words by sentence, and their df."""
    return (
        f"total AS (SELECT count(*) AS n FROM tex_units), udf AS (SELECT t, count(*) AS n FROM ({passage_terms(q)}) p GROUP BY t), "
        f"common AS (SELECT u.t, u.n, total.n AS all_n FROM udf u CROSS JOIN total WHERE {COMMON} * u.n >= total.n), "
        f"sp AS ({sentence_pairs(q)}), judged AS (SELECT s.*, x.n AS na, y.n AS nb, x.all_n FROM sp s JOIN common x ON s.a = x.t JOIN common y ON s.b = y.t), "
        "pdf AS (SELECT a, b, count(*) AS n, max(na) AS na, max(nb) AS nb, max(all_n) AS all_n FROM (SELECT DISTINCT doc_id, bucket, section, unit, a, b, na, nb, all_n FROM judged) d GROUP BY a, b)"
    )


def once(source: str, name: str, value: str) -> str:
    """Spark: source with value as a column that is made once a row. A filter on a plain column is pushed below it and makes it a second time, inside a lambda once an element."""
    return f"(SELECT s_.*, {name} FROM ({source}) s_ LATERAL VIEW explode(array({value})) x_ AS {name})"


def shared(source: str) -> str:
    """Spark: source as a table expression that is made once for all its uses, behind a shuffle; one that is deterministic would be made once a use. The condition always holds."""
    return f"SELECT * FROM ({source}) s_ WHERE rand() >= 0"


MIN_SENTENCE_WORDS = 4
SENTENCE_OF_WORDS = r"(?:\p{L}[\p{L}\x27\-]*+[^\p{L}]++){3}\p{L}"  # whether a sentence has that many words, without counting all


def cohesion_of(sentences: str) -> tuple[str, str]:
    """Spark: the sets of content words of a unit's sentences, and the shares of theirs that stand in the set c before."""
    words = f"filter(array_distinct(transform(regexp_extract_all(s, r'{DISCOURSE_WORD}', 0), w -> lower(w))), w -> w NOT IN {words_in(DISCOURSE_STOPWORDS)})"
    sets = f"transform(filter({sentences}, s -> s RLIKE r'{SENTENCE_OF_WORDS}'), s -> {words})"
    overlaps = "filter(transform(sequence(1, greatest(size(c) - 1, 1)), i -> CASE WHEN i < size(c) AND size(c[i]) > 0 THEN size(array_intersect(c[i], c[i - 1])) / CAST(size(c[i]) AS DOUBLE) END), x -> x IS NOT NULL)"
    return sets, overlaps


def numerals_of(sentences: str) -> str:
    """Spark: numerals in each of the sentences that have words enough."""
    numeral = r"(?<![A-Za-z0-9_.])[-+]?\d[\d,]*(?:\.\d+)?"
    return f"transform(filter({sentences}, s -> s RLIKE r'{SENTENCE_OF_WORDS}'), s -> IF(s RLIKE '[0-9]', regexp_count(s, r'{numeral}'), 0))"


def salience_of(c: str) -> dict[str, str]:
    """Spark: the three features from the counts of numerals."""
    run = f"aggregate({c}, named_struct('c', 0, 'b', 0), (a, v) -> IF(v > 0, named_struct('c', a.c + 1, 'b', greatest(a.b, a.c + 1)), named_struct('c', 0, 'b', a.b)), a -> a.b)"
    n = f"CAST(size({c}) AS DOUBLE)"
    return {"recital_frac": f"round(size(filter({c}, v -> v > 0)) / {n}, 6)", "numerals_per_sentence": f"round(aggregate({c}, 0, (a, v) -> a + v) / {n}, 6)", "max_recital_run_frac": f"round({run} / {n}, 6)"}


def cohesion(q: Dialect) -> str:
    """Mean share of a sentence's content words that the sentence before it has, over units of three sentences and forty words."""
    if q.name == "spark":
        sets, overlaps = cohesion_of(q.sentences_of("plain"))
        own = once(f"SELECT doc_id, section, bucket, unit, plain FROM tex_units WHERE regexp_count(plain, r'{DISCOURSE_WORD}') >= 40", "c", sets)
        shares = once(f"SELECT * FROM {own} u WHERE size(c) >= 3", "o", overlaps)
        return f"SELECT doc_id, section, bucket, unit, round(aggregate(o, CAST(0 AS DOUBLE), (a, x) -> a + x) / size(o), 6) AS cohesion FROM {shares} v WHERE size(o) > 0"
    kept = f"SELECT s.*, row_number() OVER (PARTITION BY s.doc_id, s.section, s.bucket, s.unit ORDER BY sent) AS i, count(*) OVER (PARTITION BY s.doc_id, s.section, s.bucket, s.unit) AS n FROM tex_sentences s JOIN (SELECT doc_id, section, bucket, unit FROM tex_units WHERE len(regexp_extract_all(plain, '{DISCOURSE_WORD}')) >= 40) u USING (doc_id, section, bucket, unit) WHERE len(regexp_extract_all(s, '{WORD}')) >= 4"
    sets = f"SELECT DISTINCT doc_id, section, bucket, unit, i, w FROM (SELECT doc_id, section, bucket, unit, i, lower(unnest(regexp_extract_all(s, '{DISCOURSE_WORD}'))) AS w FROM kept WHERE n >= 3) x WHERE w NOT IN {words_in(DISCOURSE_STOPWORDS)}"
    return f"WITH kept AS ({kept}), sets AS ({sets}) SELECT doc_id, section, bucket, unit, round(avg(shared / n), 6) AS cohesion FROM (SELECT c.doc_id, c.section, c.bucket, c.unit, c.i, count(p.w) AS shared, CAST(count(*) AS DOUBLE) AS n FROM sets c LEFT JOIN sets p ON c.doc_id = p.doc_id AND c.section = p.section AND c.bucket = p.bucket AND c.unit = p.unit AND c.i = p.i + 1 AND c.w = p.w WHERE c.i > 1 GROUP BY ALL) o GROUP BY ALL"


def salience(q: Dialect) -> str:
    """Share of sentences with numerals, numerals a sentence, and the longest run of such sentences, over units of three sentences and thirty words."""
    numeral = r"(?:^|[^A-Za-z0-9_.])[-+]?\d[\d,]*(?:\.\d+)?"
    text = numeral_text(q.t, "block")
    if q.name == "spark":
        numeral_texts = once("SELECT doc_id, section, bucket, unit, block FROM tex_units", "t", text)
        own = once(f"SELECT doc_id, section, bucket, unit, t FROM {numeral_texts} x WHERE regexp_count(t, r'{WORD}') >= {MIN_WORDS}", "c", numerals_of(q.sentences_of("t")))
        return f"SELECT doc_id, section, bucket, unit, {', '.join(f'{x} AS {name}' for name, x in salience_of('c').items())} FROM {own} v WHERE size(c) >= 3"
    sentences = f"SELECT doc_id, section, bucket, unit, unnest(range(len(a))) AS i, unnest(a) AS s FROM (SELECT doc_id, section, bucket, unit, {q.sentences_of('t')} AS a FROM (SELECT doc_id, section, bucket, unit, {text} AS t FROM tex_units) x WHERE len(regexp_extract_all(t, '{WORD}')) >= {MIN_WORDS}) u"
    key = "doc_id, section, bucket, unit"
    counts = f"SELECT {key}, i, len(regexp_extract_all(s, '{numeral}')) AS c, row_number() OVER (PARTITION BY {key} ORDER BY i) AS r, sum(CASE WHEN len(regexp_extract_all(s, '{numeral}')) > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY {key} ORDER BY i) AS g FROM ({sentences}) s WHERE len(regexp_extract_all(s, '{WORD}')) >= 4"
    runs = f"SELECT {key}, max(k) AS longest FROM (SELECT {key}, g, count(*) FILTER (WHERE c > 0) AS k FROM ({counts}) c GROUP BY {key}, g) r GROUP BY {key}"
    return f"SELECT {key}, round(count(*) FILTER (WHERE c > 0) / CAST(count(*) AS DOUBLE), 6) AS recital_frac, round(sum(c) / CAST(count(*) AS DOUBLE), 6) AS numerals_per_sentence, round(max(longest) / CAST(count(*) AS DOUBLE), 6) AS max_recital_run_frac FROM ({counts}) c JOIN ({runs}) l USING ({key}) GROUP BY {key} HAVING count(*) >= 3"


def hedging(q: Dialect) -> str:
    """Hedges a thousand words, over sections of 150 words."""
    words = q.t.all("plain", DISCOURSE_WORD)
    hedges = q.size(q.t.keep(words, f"lower(v) IN {words_in(HEDGES)}"))
    return f"SELECT doc_id, bucket, CAST(sum(h) AS BIGINT) AS hedge_count, CAST(sum(n) AS BIGINT) AS n_words, round(1000.0 * sum(h) / nullif(sum(n), 0), 6) AS hedging FROM (SELECT doc_id, bucket, {hedges} AS h, {q.size(words)} AS n FROM tex_units) u GROUP BY doc_id, bucket HAVING sum(n) >= 150"


def anchor(q: Dialect) -> str:
    """Whether a citation, formula, number or comparison anchors the sentence s."""
    compares = " OR ".join(f"contains(concat(' ', lower(s), ' '), '{m}')" for m in COMPARISONS)
    return f"contains(s, '[CITE]') OR contains(s, '[math]') OR contains(s, '[MATH]') OR {q.t.like('s', '[0-9]')} OR {compares}"


def anchored(q: Dialect) -> str:
    """Sentences with their section and whether they are anchored."""
    return f"SELECT doc_id, section, bucket, unit, sent, {anchor(q)} AS anchored FROM tex_sentences"


def similarity(q: Dialect, rows: str, group: str) -> str:
    """Mean pairwise cosine of vectors v1 .. v9 by group, from the sum of unit vectors: (|sum|^2 - number of non-zero ones) / (n (n - 1)). NULL for one vector."""
    norm = "sqrt(" + " + ".join(f"v{i} * v{i}" for i in range(1, 10)) + ")"
    sums = ", ".join(f"sum(CASE WHEN nrm > 0 THEN v{i} / nrm ELSE 0.0 END) AS s{i}" for i in range(1, 10))
    square = " + ".join(f"s{i} * s{i}" for i in range(1, 10))
    return f"SELECT {group}, n, CASE WHEN n > 1 THEN ({square} - nz) / (CAST(n AS DOUBLE) * (n - 1)) END AS similarity FROM (SELECT {group}, count(*) AS n, sum(CASE WHEN nrm > 0 THEN 1 ELSE 0 END) AS nz, {sums} FROM (SELECT *, {norm} AS nrm FROM ({rows}) r) x GROUP BY {group}) y"


def measurable(q: Dialect) -> str:
    """Units of 30 words in sections with two of them."""
    return f"SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, section) AS in_section FROM ({shapes(q)}) s WHERE word_count >= {MIN_WORDS}) m WHERE in_section >= 2"


def document_shape(q: Dialect) -> str:
    means = ", ".join(f"avg(v{i}) AS v{i}" for i in range(1, 10))
    first = lambda end: f"SELECT doc_id, section, {', '.join(f'v{i} AS {end}{i}' for i in range(1, 10))} FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, section ORDER BY unit{' DESC' if end == 'l' else ''}) AS r FROM m) o WHERE r = 1"
    arcs = f"SELECT f.doc_id, {', '.join(f'l{i} - f{i} AS v{i}' for i in range(1, 10))} FROM ({first('f')}) f JOIN ({first('l')}) l ON f.doc_id = l.doc_id AND f.section = l.section"
    return (
        f"WITH m AS ({measurable(q)}), within_ AS (SELECT doc_id, count(*) AS n_sections, CAST(sum(n) AS BIGINT) AS n_paragraphs, avg(similarity) AS v FROM ({similarity(q, 'SELECT * FROM m', 'doc_id, section')}) w GROUP BY doc_id), "
        f"cross_ AS ({similarity(q, f'SELECT doc_id, section, {means} FROM m GROUP BY doc_id, section', 'doc_id')}), arc AS ({similarity(q, arcs, 'doc_id')}) "
        "SELECT w.doc_id, CASE WHEN n_sections >= 3 THEN 'measured' ELSE 'insufficient_evidence' END AS status, n_sections, n_paragraphs, CASE WHEN n_sections >= 3 THEN round(w.v, 6) END AS within_section, CASE WHEN n_sections >= 3 THEN round(c.similarity, 6) END AS cross_section, CASE WHEN n_sections >= 3 THEN round(a.similarity, 6) END AS section_arc "
        "FROM within_ w JOIN cross_ c ON w.doc_id = c.doc_id JOIN arc a ON w.doc_id = a.doc_id"
    )


def deviation(q: Dialect, v: str, order: str) -> str:
    """An aggregate: the population deviation of v. Spark runs through the values in the given order with the steps of the oracle's stddev_pop, whose last bits decide where a deviation lies halfway between two rounded ones."""
    if q.name != "spark":
        return f"stddev_pop({v})"
    step = "named_struct('n', a.n + 1, 'm', a.m + (x.v - a.m) / (a.n + 1), 'd', a.d + (x.v - (a.m + (x.v - a.m) / (a.n + 1))) * (x.v - a.m))"
    return f"aggregate(array_sort(collect_list(struct({order}, CAST({v} AS DOUBLE) AS v))), named_struct('n', 0D, 'm', 0D, 'd', 0D), (a, x) -> {step}, a -> sqrt(a.d / a.n))"


def rounded(q: Dialect, x: str) -> str:
    """x, not negative, to six digits; Spark rounds the product with a million, as the oracle does, not the shortest decimal."""
    return f"(floor({x} * 1e6) + CASE WHEN {x} * 1e6 - floor({x} * 1e6) >= 0.5 THEN 1 ELSE 0 END) / 1e6" if q.name == "spark" else f"round({x}, 6)"


def dispersion(q: Dialect) -> str:
    """Spread of each feature over a document's units in order: std, cv, iqr, lag-1 autocorrelation and the smallest step."""
    rows = f"SELECT doc_id, feature, v, avg(v) OVER (PARTITION BY doc_id, feature) AS m, lead(v) OVER (PARTITION BY doc_id, feature ORDER BY section, unit) AS nv{', section, unit' if q.name == 'spark' else ''} FROM ({long_features(q)}) f"
    quantile = lambda p: f"percentile_cont({p}) WITHIN GROUP (ORDER BY v)"
    return (
        f"SELECT doc_id, feature, n, {rounded(q, 'sd')} AS std, CASE WHEN m <> 0 THEN {rounded(q, 'sd / abs(m)')} END AS cv, round(iqr + 1e-9, 6) AS iqr, CASE WHEN n >= 3 AND ss > 1e-12 THEN round(num / ss, 6) END AS lag1_autocorr, round(gap, 6) AS min_gap "
        f"FROM (SELECT doc_id, feature, count(*) AS n, {deviation(q, 'v', 'section, unit')} AS sd, max(m) AS m, {quantile(0.75)} - {quantile(0.25)} AS iqr, sum((v - m) * (v - m)) AS ss, sum((v - m) * (nv - m)) AS num, min(abs(nv - v)) AS gap FROM ({rows}) r GROUP BY doc_id, feature) a WHERE n >= 2"
    )


def native_stems(q: Dialect) -> str:
    """Words outside the common ones and the attested stem they derive from: the longest suffix first, then the root, root + e, root + y and the root without a doubled letter."""
    def cut(word: str, n: int) -> str:
        return f"substr({word}, 1, length({word}) - {n})"

    forms = [(i, k, s, form) for i, s in enumerate(STEM_SUFFIXES) for k, form in enumerate((cut("t", len(s)), f"concat({cut('t', len(s))}, 'e')", f"concat({cut('t', len(s))}, 'y')", cut("t", len(s) + 1)))]
    fits = lambda k, s: f"t LIKE '%{s}' AND length(t) - {len(s)} >= 3{' AND substr(t, length(t) - ' + str(len(s)) + ', 1) = substr(t, length(t) - ' + str(len(s) + 1) + ', 1)' if k == 3 else ''}"
    if q.name == "spark":  # all roots of a word within its row: a union would count the words of the corpus once a branch
        made = ", ".join(f"IF({fits(k, s)}, named_struct('place', {i}, 'form', {k}, 'root', {form}), NULL)" for i, k, s, form in forms)
        return f"WITH {bank(q)} SELECT r.t, min_by(r.x.root, struct(r.x.place, r.x.form)) AS stem FROM (SELECT t, x FROM udf LATERAL VIEW explode(filter(array({made}), f -> f IS NOT NULL)) y AS x WHERE n = 1) r JOIN common c ON r.x.root = c.t WHERE c.n >= 3 GROUP BY r.t"
    roots = " UNION ALL ".join(f"SELECT t, {i} AS place, {k} AS form, {form} AS root FROM rare WHERE {fits(k, s)}" for i, k, s, form in forms)
    return f"WITH {bank(q)}, rare AS (SELECT t FROM udf WHERE n = 1), roots AS ({roots}) SELECT t, stem FROM (SELECT r.t, r.root AS stem, row_number() OVER (PARTITION BY r.t ORDER BY r.place, r.form) AS k FROM roots r JOIN common c ON r.root = c.t WHERE c.n >= 3) x WHERE k = 1"


def glossary(q: Dialect) -> str:
    return f"WITH {bank(q)} SELECT doc_id, a, b, count(*) AS uses, count(DISTINCT section) AS sections, min(section * 1000000 + unit) AS first_place FROM judged GROUP BY doc_id, a, b HAVING count(*) >= 2"


def novel(q: Dialect) -> str:
    """Sentences with four different judged pairs, and the share of those that no other passage holds."""
    return f"SELECT doc_id, section, bucket, unit, sent, count(*) AS judged, sum(CASE WHEN n < 2 THEN 1 ELSE 0 END) AS novel FROM (SELECT DISTINCT j.doc_id, j.section, j.bucket, j.unit, j.sent, j.a, j.b, p.n FROM judged j JOIN pdf p ON j.a = p.a AND j.b = p.b) d GROUP BY doc_id, section, bucket, unit, sent HAVING count(*) >= {MIN_JUDGED}"


UNIT = "doc_id, section, bucket, unit"

QUERIES = {
    "x2_distribution_vector": features,
    "x3_shape_vector": lambda q: f"SELECT {UNIT}, {', '.join(f'round(v{i} + 1e-9, 6) AS v{i}' for i in range(1, 10))} FROM ({shapes(q)}) s",
    "x4_densities": lambda q: f"SELECT doc_id, section, bucket, unit, CASE WHEN n > 0 THEN round(100.0 * maths / n, 6) ELSE 0.0 END AS math_density, CASE WHEN n > 0 THEN round(100.0 * listed / n, 6) ELSE 0.0 END AS lexicon_density FROM (SELECT {UNIT}, {q.size('w')} AS n, {q.t.count('block', INLINE)} AS maths, {q.size(q.t.keep('w', f'lower(v) IN {words_in(TYPICAL_WORDS)}'))} AS listed FROM (SELECT {UNIT}, block, {prose_words(q.t, 'plain')} AS w FROM tex_units) u) d",
    "x7_numerals": lambda q: f"SELECT {UNIT}, {q.t.count('plain', r'(?<![A-Za-z0-9_.])[-+]?\d[\d,]*(?:\.\d+)?' if q.name == 'spark' else r'(?:^|[^A-Za-z0-9_.])[-+]?\d[\d,]*(?:\.\d+)?')} AS numerals FROM tex_units",
    "a4_lexicon": lambda q: f"SELECT l.w, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) = 0 AS absent FROM ({listed(TYPICAL_WORDS)}) l LEFT JOIN (SELECT lower(w) AS w, count(*) AS n FROM words GROUP BY lower(w)) c ON l.w = c.w",
    "a3_opening_words": lambda q: f"SELECT o.w, CAST(coalesce(n, 0) AS BIGINT) AS n FROM ({listed(OPENING_WORDS)}) o LEFT JOIN (SELECT w, count(*) AS n FROM (SELECT {q.t.first('plain', '^' + chr(92) + 's*(' + '|'.join(OPENING_WORDS) + ')', 1)} AS w FROM tex_units) u GROUP BY w) c ON o.w = c.w",
    "a3_top_opening_words": lambda q: f"SELECT w, n, CAST(place AS BIGINT) AS place FROM (SELECT w, n, row_number() OVER (ORDER BY n DESC, w) AS place FROM (SELECT w, count(*) AS n FROM (SELECT {q.t.first('plain', WORD)} AS w FROM tex_units) u WHERE w <> '' GROUP BY w ORDER BY n DESC, w LIMIT 30) t) r",
    "a5_document_frequency": lambda q: f"SELECT t, count(*) AS n FROM ({passage_terms(q)}) p GROUP BY t",
    "a6_pair_bank": lambda q: f"WITH {bank(q)} SELECT a, b, n FROM pdf",
    "a7_quantile_grid": lambda q: grid(q, long_features(q)),
    "a8_reference_builder": lambda q: f"SELECT bucket, feature, count(*) AS n, count(DISTINCT doc_id) AS sources, min(v) AS low, max(v) AS high, count(*) >= {MIN_REFERENCE} AS usable FROM ({long_features(q)}) f GROUP BY bucket, feature",
    "a10_structure_fractions": lambda q: f"SELECT bucket, count(*) AS n, {', '.join(f'round(avg(CASE WHEN contains(templates, {chr(39)}{x}{chr(39)}) THEN 1.0 ELSE 0.0 END), 6) AS {x.replace(chr(45), chr(95))}' for x in ('announced-enumeration', 'announced-count', 'ordinal-run', 'tricolon-wrapup', 'parallel-anaphora', 'parallel-modal', 'balanced-closer'))}, {', '.join(f'round(avg(CASE WHEN contains(auxiliary, {chr(39)}{x}{chr(39)}) THEN 1.0 ELSE 0.0 END), 6) AS {x.replace(chr(45), chr(95))}' for x in ('antithesis-cluster', 'short-reversal', 'paper-agent', 'wh-cleft', 'modifier-stack'))}, round(avg(CASE WHEN templates <> '' THEN 1.0 ELSE 0.0 END), 6) AS any_template FROM ({structure(q)}) s JOIN (SELECT DISTINCT doc_id AS d, section AS c, unit AS u, bucket FROM tex_units) b ON s.doc_id = b.d AND s.section = b.c AND s.unit = b.u GROUP BY bucket",
    "a11_w7_dispersion": dispersion,
    "a12_pairwise_similarity": lambda q: f"SELECT doc_id, section, n, round(similarity, 6) AS similarity FROM ({similarity(q, measurable(q), 'doc_id, section')}) s",
    "a13_document_shape": document_shape,
    "a21_class_rates": lambda q: f"SELECT doc_id, class, count(*) AS n_sections, round(avg(rate), 6) AS rate FROM (SELECT doc_id, section, CASE bucket WHEN 'intro' THEN 'intro' WHEN 'method' THEN 'methods' WHEN 'data' THEN 'methods' WHEN 'results' THEN 'results' WHEN 'discussion' THEN 'discussion' WHEN 'conclusion' THEN 'conclusions' ELSE 'other' END AS class, avg(CASE WHEN anchored THEN 1.0 ELSE 0.0 END) AS rate FROM ({anchored(q)}) a GROUP BY doc_id, section, bucket) s GROUP BY doc_id, class",
    "a22_w1_cohesion": cohesion,
    "a23_hedging": hedging,
    "a24_salience": salience,
    "a40_document_novelty": lambda q: f"WITH {bank(q)} SELECT j.doc_id, count(*) AS judged, CAST(sum(CASE WHEN p.n < 2 THEN 1 ELSE 0 END) AS BIGINT) AS novel FROM judged j JOIN pdf p ON j.a = p.a AND j.b = p.b GROUP BY j.doc_id",
    "a41_sentence_novelty": lambda q: f"WITH {bank(q)} SELECT doc_id, section, bucket, unit, CAST(sent AS BIGINT) AS sent, judged, CAST(novel AS BIGINT) AS novel FROM ({novel(q)}) n",
    "a42_o5_glossary": glossary,
    "a50_calibrations": lambda q: grid(q, f"SELECT bucket, 'cohesion' AS feature, cohesion AS v FROM ({cohesion(q) if q.name == 'spark' else cohesion(q)}) c UNION ALL SELECT bucket, 'hedging', hedging FROM ({hedging(q)}) h UNION ALL SELECT bucket, 'recital_frac', recital_frac FROM ({salience(q)}) s"),
    "d10_zero_df_words": lambda q: f"SELECT h.doc_id, h.w, count(*) AS n FROM (SELECT doc_id, lower(w) AS w FROM ({q.explode('doc_id', 'p', 'w', q.t.all('plain', WORD), 'tex_units')}) a) h JOIN (SELECT l.w FROM ({listed(TYPICAL_WORDS)}) l LEFT JOIN (SELECT DISTINCT lower(w) AS w FROM words) c ON l.w = c.w WHERE c.w IS NULL) z ON h.w = z.w GROUP BY h.doc_id, h.w",
    "f7_anchored_sentences": lambda q: f"SELECT doc_id, section, bucket, unit, CAST(sent AS BIGINT) AS sent, anchored FROM ({anchored(q)}) a",
    "f11_usable_buckets": lambda q: f"SELECT bucket, feature, n, n >= {MIN_REFERENCE} AND {element(q, 101)} > {element(q, 91)} AS high_resolves, n >= {MIN_REFERENCE} AND {element(q, 11)} > {element(q, 1)} AS low_resolves FROM ({grid_arrays(q, long_features(q))}) g",
    "f12_corpus_resolution": lambda q: "SELECT count(*) AS n, 1.0 / count(*) < 0.0001 AS resolves FROM tex_units",
    "f13_f14_judged_common_pairs": lambda q: f"WITH {bank(q)} SELECT doc_id, section, bucket, unit, CAST(sent AS BIGINT) AS sent, count(*) AS judged FROM (SELECT DISTINCT doc_id, section, bucket, unit, sent, a, b FROM judged) d GROUP BY doc_id, section, bucket, unit, sent HAVING count(*) >= {MIN_JUDGED}",
    "g15_content_pairs": lambda q: f"SELECT doc_id, section, bucket, unit, CAST(sent AS BIGINT) AS sent, a, b FROM ({sentence_pairs(q)}) p",
    "g17_measurable_sections": lambda q: f"SELECT doc_id, section, count(*) AS n_blocks, CAST(sum(word_count) AS BIGINT) AS n_words FROM ({measurable(q)}) m GROUP BY doc_id, section",
    "j6_percentile_of": lambda q: f"SELECT f.doc_id, f.section, f.unit, f.feature, f.v, round({percentile(q, 'val')}, 6) AS percentile FROM (SELECT doc_id, section, unit, bucket, feature, v, v AS val FROM ({long_features(q)}) l) f JOIN ({grid_arrays(q, long_features(q))}) g ON f.bucket = g.bucket AND f.feature = g.feature",
    "j7_grid_value": lambda q: f"SELECT bucket, feature, step, v FROM ({grid(q, long_features(q))}) g WHERE step IN (5, 10, 90, 95)",
    "o4_novel_pairs_shown": lambda q: f"WITH {bank(q)} SELECT doc_id, section, unit, CAST(sent AS BIGINT) AS sent, a, b, CAST(place AS BIGINT) AS place FROM (SELECT doc_id, section, unit, sent, a, b, row_number() OVER (PARTITION BY doc_id, section, bucket, unit, sent ORDER BY CAST(na AS DOUBLE) * nb DESC, a, b) AS place FROM (SELECT DISTINCT j.doc_id, j.section, j.bucket, j.unit, j.sent, j.a, j.b, p.na, p.nb FROM judged j JOIN pdf p ON j.a = p.a AND j.b = p.b WHERE p.n < 2) d) r WHERE place <= 4",
    "p13_native_stems": native_stems,
    "x12_expected_pairs": lambda q: f"WITH {bank(q)} SELECT a, b, n, round(CAST(na AS DOUBLE) * nb / all_n, 6) AS expected, round(exp(-CAST(na AS DOUBLE) * nb / all_n), 6) AS p_none FROM pdf",
    "x13_rarest_part": lambda q: f"WITH {bank(q)} SELECT w AS compound, min(coalesce(u.n, 0)) AS n FROM (SELECT DISTINCT w, part FROM ({q.explode('w', 'i', 'part', q.t.split('w', '-'), f'(SELECT DISTINCT t AS w FROM udf WHERE t LIKE {chr(39)}%-%{chr(39)}) c')}) p WHERE length(part) >= 3) k LEFT JOIN udf u ON k.part = u.t GROUP BY w",
}


def listed(values) -> str:  # noqa: ANN001
    return " UNION ALL ".join(f"SELECT '{v}' AS w" for v in values)


def element(q: Dialect, i: int) -> str:
    return f"g[{i - 1}]" if q.name == "spark" else f"g[{i}]"
