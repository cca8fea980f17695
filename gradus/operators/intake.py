"""Reading question papers: sections, question types, options, statements, classes and exams.

The standard tables hold no question papers, so that these queries read a bank made of `part`:
each part asks one of the questions below, with its own number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import intake as read
from ..functions.text import LATEX, difficulty, equation_key, equation_likeness, has_latex, option_index, primary_latex, stripped_latex
from .registry import query

#: Lines of a question are divided by a bar, backslashes are written as ~; # is the part's number.
ASKED = (
    "Q#. Find the value of it (A) 1/2 (B) 3/4 of $(b) x$ (C) $y$ (D) none",
    "Read the following passage based on rivers. Class XII and class 11",
    "Match the following: Column I with Column II for JEE Main",
    "One or more correct answers: (a) red (b) blue",
    "Integer type answer for grade 9 of NCERT",
    "Round off to two decimal places, NEET hard problem",
    "A body of 5 kg moves. Chapter: Laws of Motion, std. 11",
    "Only (a) is given here, simple",
    "Explain photosynthesis in detail for the board in full, with a sketch of the leaf, the light and the dark reaction and all that enters or leaves it; CBSE",
    "SECTION B: Numerical value",
    "Assertion: x holds. Reason: y holds. Only a and b hold. (A) p (B) q (C) r",
    "True or false: class 99 exists, as does std 8",
    "Which hold?|(i) first one|(ii) second one|3. third|A) opt one|B. opt two|  continued here|C: opt three|and a long tail",
    "Physics",
    "Part C - Single correct",
    "Area $~frac{a}{b}$ and ~(c_1~) then $$ x^{2} $$ of ~[ y ~]",
    "Area a/b and c_1 then",
    "Comprehension: select all that apply",
    "",
    "Case study of P(A) and P(B): numeric (c) so (a) no (b) yes (C) maybe (d) last",
)
_CASES = " ".join(f"WHEN {i} THEN '{text}'" for i, text in enumerate(ASKED))
#: In Spark's SQL and in others alike.
_BANK = f"SELECT p_partkey AS qid, replace(replace(replace(CASE p_partkey % {len(ASKED)} {_CASES} END, '#', CAST(p_partkey AS VARCHAR(20))), '|', chr(10)), '~', chr(92)) AS body, p_size % 10 AS marks, p_type AS chapter FROM part"
_LINES = f"SELECT qid, CAST(pos AS BIGINT) AS pos, line FROM (SELECT qid, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT qid, string_split(body, chr(10)) AS ls FROM ({_BANK})))"


def bank(t) -> DataFrame:
    """qid, body, marks, chapter of each question."""
    cases = F.lit(None).cast("string")
    for i, text in enumerate(ASKED):
        cases = F.when(F.col("p_partkey") % len(ASKED) == i, text).otherwise(cases)
    body = F.translate(F.replace(cases, F.lit("#"), F.col("p_partkey").cast("string")), "|~", "\n\\")
    return t("part").select(F.col("p_partkey").alias("qid"), body.alias("body"), (F.col("p_size") % 10).alias("marks"), F.col("p_type").alias("chapter"))


def lines(t) -> DataFrame:
    """qid, pos (from 1) and line of each question's lines."""
    l = bank(t).select("qid", F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    return l.select("qid", (F.col("pos") + 1).cast("bigint").alias("pos"), "line")


def _first(pairs, test: str, final: str = "NULL") -> str:
    """A chain of cases in SQL."""
    return "CASE " + " ".join(f"WHEN {test.format(p=p)} THEN '{v}'" for p, v in pairs) + f" ELSE {final} END"


_MATCH = "regexp_matches(body, '(?i){p}')"


@query(f"SELECT qid, pos, lower(regexp_extract(l, '{read.OPTION_LINE}', 1) || regexp_extract(l, '{read.OPTION_LINE}', 2)) AS label, trim(regexp_extract(l, '{read.OPTION_LINE}', 3), ' ') AS text FROM (SELECT qid, pos, trim(line, ' ') AS l FROM ({_LINES})) WHERE regexp_matches(l, '{read.OPTION_LINE}')")
def option_lines(t) -> DataFrame:
    """Lines that are options, with label and text."""
    l = F.trim("line")
    return lines(t).where(read.is_option(l)).select("qid", "pos", read.option_label(l).alias("label"), read.option_text(l).alias("text"))


_SEEN = f"SELECT qid, i, rest, prev FROM (SELECT qid, i, substr(s, i, 12) AS rest, CASE WHEN i = 1 THEN ' ' ELSE substr(s, i - 1, 1) END AS prev FROM (SELECT qid, s, unnest(range(1, length(s) + 1)) AS i FROM (SELECT qid, regexp_replace(regexp_replace(body, '[$][$][^$]+[$][$]', '', 'g'), '[$][^$]+[$]', '', 'g') AS s FROM ({_BANK}))))"


@query(f"""SELECT b.qid, CAST(coalesce(n, 0) AS BIGINT) AS markers, coalesce(n, 0) >= 2 AS is_choice FROM ({_BANK}) b LEFT JOIN (SELECT qid, count(DISTINCT lower(regexp_extract(rest, '[a-fA-F]'))) AS n FROM ({_SEEN})
 WHERE (regexp_matches(rest, '^[(][ ]*[a-fA-F][ ]*[)]') AND NOT regexp_matches(prev, '[A-Za-z0-9]')) OR (regexp_matches(rest, '^[a-fA-F][ ]*[).]') AND NOT regexp_matches(prev, '[A-Za-z0-9_]')) GROUP BY qid) m USING (qid)""")
def option_markers(t) -> DataFrame:
    """Distinct option markers of each question, formulas left out; two make a choice."""
    n = F.size(F.array_distinct(read.marker_labels(F.col("body")))).cast("bigint")
    return bank(t).select("qid", n.alias("markers"), (n >= 2).alias("is_choice"))


#: Of each kind of asked question: the run of labels, and the text of its options.
_RUNS = {0: ("abcd", "$\\frac{1}{2}$/$\\frac{3}{4}$ of $(b) x$/$y$/none"), 3: ("ab", "red/blue"), 10: ("abc", "p/q/r"), 12: ("ab", "opt one/opt two\n  continued here\nC: opt three\nand a long tail"), 19: ("abcd", "and P(/numeric/so (a) no (b) yes (C) maybe/last")}
_RUN_ROWS = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in _RUNS.items())


@query(f"SELECT qid, labels, options FROM ({_BANK}) JOIN (VALUES {_RUN_ROWS}) AS r (kind, labels, options) ON qid % {len(ASKED)} = kind")
def option_runs(t) -> DataFrame:
    """The longest run of labels in order, and the text of each, formulas kept whole.

    The SQL states what each kind of question must give.
    """
    # A row of a generator is made once, for the condition and for both texts.
    q = bank(t).select("qid", F.explode(F.array(read.inline_options(F.col("body")))).alias("o")).where("size(o) >= 2")
    # An option longer than its label's first is kept, so that the run has each label once.
    return q.select("qid", F.array_join(F.transform("o", lambda x: x["label"]), "").alias("labels"), F.array_join(F.transform("o", lambda x: x["text"]), "/").alias("options"))


_HEADER = "^(SECTION|PART) *[-:]? *([A-Za-z0-9]+)( *[-:] *(.+))?$"


@query(f"""SELECT qid, pos, CASE WHEN regexp_matches(l, '(?i){_HEADER}') THEN 'Section ' || regexp_extract(l, '(?i){_HEADER}', 2) ELSE coalesce({_first([(p, n) for p, n, _ in read.SECTIONS], "regexp_matches(l, '(?i){p}')")}, l) END AS name,
 CASE WHEN regexp_matches(l, '(?i){_HEADER}') THEN NULL ELSE {_first([(p, k) for p, _, k in read.SECTIONS], "regexp_matches(l, '(?i){p}')")} END AS part
FROM (SELECT qid, pos, trim(line, ' ') AS l FROM ({_LINES})) WHERE regexp_matches(l, '(?i){_HEADER}') OR regexp_matches(l, '(?i){"|".join(p for p, _, _ in read.SECTIONS)}') OR (regexp_matches(l, '(?i)^mathematics|^physics|^chemistry') AND length(l) < 40)""")
def section_headers(t) -> DataFrame:
    """Lines that open a section, with its name and kind of questions."""
    l = F.trim("line")
    return lines(t).select("qid", "pos", read.section_name(l).alias("name"), read.section_part(l).alias("part")).where("name is not null")


@query(f"""SELECT qid, subtype, CASE WHEN subtype IN ('mcq_multiple', 'mcq_single', 'mcq_incomplete') THEN 'mcq' WHEN subtype IN ('integer', 'numerical') THEN 'numerical' ELSE 'descriptive' END AS type FROM (
 SELECT qid, CASE WHEN {_MATCH.format(p=read.COMPREHENSION)} THEN 'comprehension' WHEN {_MATCH.format(p=read.MATCHING)} THEN 'match_following'
 WHEN {_MATCH.format(p=read.SEVERAL)} AND n >= 2 THEN 'mcq_multiple' WHEN n >= 2 THEN 'mcq_single' WHEN {_MATCH.format(p=read.INTEGER)} OR regexp_matches(body, '^ *[0-9]+ *$') THEN 'integer'
 WHEN {_MATCH.format(p=read.NUMERICAL)} OR {_MATCH.format(p=read.UNIT)} THEN 'numerical' WHEN regexp_matches(body, '[(][a-fA-F][)]') AND n = 1 THEN 'mcq_incomplete' ELSE 'descriptive' END AS subtype
 FROM (SELECT b.qid, body, coalesce(n, 0) AS n FROM ({_BANK}) b LEFT JOIN (SELECT qid, count(DISTINCT lower(regexp_extract(rest, '[a-fA-F]'))) AS n FROM ({_SEEN})
 WHERE (regexp_matches(rest, '^[(][ ]*[a-fA-F][ ]*[)]') AND NOT regexp_matches(prev, '[A-Za-z0-9]')) OR (regexp_matches(rest, '^[a-fA-F][ ]*[).]') AND NOT regexp_matches(prev, '[A-Za-z0-9_]')) GROUP BY qid) m USING (qid)))""")
def question_type(t) -> DataFrame:
    """Type and subtype of each question, the first rule that holds."""
    sub = read.subtype(F.col("body"))
    return bank(t).select("qid", sub.alias("subtype")).withColumn("type", read.type_of(F.col("subtype")))


_KINDS = {0: "MCQ_SINGLE", 1: "COMPREHENSION", 2: "MATCH_COLUMNS", 3: "MCQ_MULTI", 4: "INTEGER", 9: "NUMERICAL", 10: "ASSERTION_REASON", 11: "TRUE_FALSE", 12: "MCQ_SINGLE", 17: "COMPREHENSION", 19: "CASE_STUDY"}


@query(f"SELECT qid, CASE qid % {len(ASKED)} {' '.join(f'''WHEN {k} THEN '{v}' ''' for k, v in _KINDS.items())} ELSE 'DESCRIPTIVE' END AS kind FROM ({_BANK})")
def semantic_type(t) -> DataFrame:
    """One of twelve kinds for each question; the SQL states what each must give."""
    return bank(t).select("qid", read.semantic_kind(F.col("body")).alias("kind"))


_SAID = "(?i)^ *(?:[(]? *(?:[iI]+|[0-9]+|[a-zA-Z]) *[)]? *[.:-] +|(?:Statement +[0-9]+) *[.:-] +)(.+)$"


@query(f"SELECT qid, pos, trim(regexp_extract(l, '{_SAID}', 1), ' ') AS statement FROM (SELECT qid, pos, trim(line, ' ') AS l FROM ({_LINES})) WHERE regexp_matches(l, '{_SAID}')")
def statements(t) -> DataFrame:
    """Numbered or lettered statements among the lines."""
    l = F.trim("line")
    return lines(t).where(read.is_statement(l)).select("qid", "pos", read.statement(l).alias("statement"))


_VALID = [f"CASE WHEN TRY_CAST(regexp_extract(body, '(?i){p}', 1) AS INT) BETWEEN 6 AND 12 THEN TRY_CAST(regexp_extract(body, '(?i){p}', 1) AS INT) END" for p in read.CLASS_NUMBERS]
_ROMAN = "CASE lower(regexp_extract(body, '(?i)" + read.CLASS_ROMAN + "', 1)) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in read.ROMAN.items()) + " END"
_ALL = " || ".join([f"list_transform(list_filter(regexp_extract_all(body, '(?i){p}', 1), lambda x: TRY_CAST(x AS INT) BETWEEN 6 AND 12), lambda x: CAST(x AS INT))" for p in read.CLASS_NUMBERS] + ["list_transform(regexp_extract_all(body, '(?i)" + read.CLASS_ROMAN + "', 1), lambda x: CASE lower(x) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in read.ROMAN.items()) + " END)"])


@query(f"SELECT qid, coalesce({', '.join(_VALID)}, {_ROMAN}, 11) AS class, array_to_string(list_sort(list_distinct({_ALL})), ',') AS classes FROM ({_BANK})")
def class_levels(t) -> DataFrame:
    """The class a question is for, 11 if it names none from 6 to 12; and all that it names."""
    b = F.col("body")
    return bank(t).select("qid", F.coalesce(read.class_number(b), F.lit(11)).alias("class"), F.array_join(F.array_sort(read.classes(b)), ",").alias("classes"))


_EXAM = _first(read.EXAMS, _MATCH)


@query(f"SELECT qid, {_EXAM} AS exam FROM ({_BANK})")
def exam_hint(t) -> DataFrame:
    """Code of the exam that a question names first, by the order of the rules."""
    return bank(t).select("qid", read.exam(F.col("body")).alias("exam"))


_HARD = f"CASE WHEN {_MATCH.format(p=read.EASY)} THEN 'easy' WHEN {_MATCH.format(p=read.HARD)} THEN 'hard' WHEN marks >= 8 OR length(body) > 450 THEN 'hard' WHEN marks <= 2 OR length(body) < 120 THEN 'easy' ELSE 'medium' END"


@query(f"SELECT qid, {_HARD} AS difficulty FROM ({_BANK})")
def difficulty_rules(t) -> DataFrame:
    """Difficulty by the words of a question, then by its marks and length."""
    return bank(t).select("qid", difficulty(F.col("body"), F.col("marks")).alias("difficulty"))


_CLASSIFIED = f"""SELECT b.qid, c.class, exam, subject, difficulty, len(string_split(nullif(classes, ''), ',')) > 1 AS mixed,
 list_filter([CASE WHEN subject IS NULL THEN 'subject' END, CASE WHEN exam IS NULL THEN 'exam' END], lambda x: x IS NOT NULL) AS gaps
FROM ({_BANK}) b JOIN (SELECT qid, coalesce({', '.join(_VALID)}, {_ROMAN}, 11) AS class, array_to_string(list_sort(list_distinct({_ALL})), ',') AS classes, {_EXAM} AS exam, {_HARD} AS difficulty,
 CASE WHEN contains(lower(body), 'physics') OR contains(lower(body), 'motion') THEN 'physics' WHEN contains(lower(body), 'photosynthesis') THEN 'biology' END AS subject FROM ({_BANK})) c USING (qid)"""


@query(f"""SELECT qid, class, exam, subject, difficulty, coalesce(mixed, false) AS mixed, array_to_string(gaps, ',') AS gaps,
 CAST(floor((0.7e0 + CASE WHEN subject IS NULL THEN 0e0 ELSE 0.75e0 END + CASE WHEN exam IS NULL THEN 0e0 ELSE 0.7e0 END) / (1 + CASE WHEN subject IS NULL THEN 0 ELSE 1 END + CASE WHEN exam IS NULL THEN 0 ELSE 1 END) * 100 + 0.5e0) AS BIGINT) AS confidence,
 CASE WHEN subject IS NULL OR exam IS NULL OR coalesce(mixed, false) THEN 'needs_review' ELSE 'pending' END AS status FROM ({_CLASSIFIED})""")
def rules_classification(t) -> DataFrame:
    """Class, exam, subject and difficulty of each question, what is missing, and whether a
    person has to look: the mean of the scores of what is known is the confidence."""
    b = F.lower("body")
    subject = F.when(b.contains("physics") | b.contains("motion"), "physics").when(b.contains("photosynthesis"), "biology")
    q = bank(t).select("qid", F.coalesce(read.class_number(F.col("body")), F.lit(11)).alias("class"), read.exam(F.col("body")).alias("exam"), subject.alias("subject"), difficulty(F.col("body"), F.col("marks")).alias("difficulty"), (F.size(read.classes(F.col("body"))) > 1).alias("mixed"))
    scores = F.array_compact(F.array(F.lit(0.7), F.when(F.col("subject").isNotNull(), 0.75), F.when(F.col("exam").isNotNull(), 0.7)))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores)
    gaps = F.concat_ws(",", F.when(F.col("subject").isNull(), "subject"), F.when(F.col("exam").isNull(), "exam"))
    review = F.col("subject").isNull() | F.col("exam").isNull() | F.col("mixed")
    return q.withColumns({"gaps": gaps, "confidence": F.floor(mean * 100 + 0.5).cast("bigint"), "status": F.when(review, "needs_review").otherwise("pending")})


_HAS = "regexp_matches(body, '[$]|\\\\frac|\\\\sqrt|\\\\int|\\\\sum|\\\\begin\\{|\\\\alpha|\\\\beta|\\\\pi|_\\{|_[A-Za-z0-9_]|\\^\\{|\\^[A-Za-z0-9_]')"
_PRIMARY = "nullif(trim(coalesce(" + ", ".join(f"nullif(regexp_extract(body, '{p}', 1), '')" for p in (LATEX[0], LATEX[1], LATEX[2], LATEX[3])) + "), ' '), '')"
_BARE = "body"
for _p in LATEX:
    _BARE = f"regexp_replace({_BARE}, '{_p}', '\\1', 'g')"


@query(f"SELECT qid, {_HAS} AS has_latex, CASE WHEN {_HAS} THEN coalesce({_PRIMARY}, body) END AS latex, trim({_BARE}, ' ') AS bare FROM ({_BANK})")
def latex_fields(t) -> DataFrame:
    """Whether a question holds LaTeX, the first formula, and the text without its marks."""
    b = F.col("body")
    return bank(t).select("qid", has_latex(b).alias("has_latex"), F.when(has_latex(b), F.coalesce(primary_latex(b), b)).alias("latex"), stripped_latex(b).alias("bare"))


@query(f"SELECT a.qid AS a, b.qid AS b, CASE WHEN a.qid % {len(ASKED)} = 15 AND b.qid % {len(ASKED)} = 15 THEN 1e0 ELSE 0e0 END AS likeness FROM ({_BANK}) a JOIN ({_BANK}) b ON b.qid = a.qid + {len(ASKED)} WHERE a.qid % {len(ASKED)} IN (8, 15)")
def equation_pairs(t) -> DataFrame:
    """Likeness of formulas of equal questions; plain texts, however alike, have none."""
    q = bank(t).where((F.col("qid") % len(ASKED)).isin(8, 15))
    q = q.select("qid", "body", equation_key(F.col("body")).alias("key"))
    o = q.select(*(F.col(c).alias(f"{c}_") for c in q.columns))
    pairs = q.join(o, F.col("qid_") == F.col("qid") + len(ASKED))
    return pairs.select(F.col("qid").alias("a"), F.col("qid_").alias("b"), equation_likeness(F.col("key"), F.col("key_"), has_latex(F.col("body")) | has_latex(F.col("body_"))).alias("likeness"))


@query("SELECT c_custkey, CASE upper(substr(c_name, length(c_name), 1)) WHEN 'A' THEN 0 END AS by_letter, CAST(ascii(substr('ABCDEF', CAST(c_custkey % 6 AS INT) + 1, 1)) - 65 AS INT) AS by_key FROM customer")
def answer_letters(t) -> DataFrame:
    """Place of the option that a letter names; null for what is no letter from A to F."""
    letter = F.substring(F.lit("ABCDEF"), (F.col("c_custkey") % 6).cast("int") + 1, F.lit(1))
    return t("customer").select("c_custkey", option_index(F.substring("c_name", -1, 1)).alias("by_letter"), option_index(letter).alias("by_key"))


@query(f"SELECT c_custkey, replace(replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, c AS again FROM (SELECT c_custkey, '<b>' || c_name || '</b> & \"' || c_mktsegment || '\" it''s' AS c FROM customer)")
def html_escapes(t) -> DataFrame:
    """Text as HTML, and decoded again: named, decimal and hexadecimal references."""
    c = F.concat(F.lit("<b>"), "c_name", F.lit('</b> & "'), "c_mktsegment", F.lit("\" it's"))
    return t("customer").select("c_custkey", read.html_escaped(c).alias("escaped")).withColumn("again", read.html_unescaped(F.col("escaped")))


@query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' , , ' || p_type, ','), lambda x: trim(x, ' ')), lambda x: x <> ''), '|') AS listed, regexp_matches(p_name || '.(x)', regexp_escape('.(x)') || '$') AS found FROM part")
def list_params(t) -> DataFrame:
    """A comma-separated parameter as a list without blanks; and a pattern made of plain text."""
    p = t("part").select("p_partkey", read.listed(F.concat("p_name", F.lit(" , , "), "p_type")).alias("l"), F.concat("p_name", F.lit(".(x)")).alias("c"))
    return p.select("p_partkey", F.array_join("l", "|").alias("listed"), F.regexp_like("c", F.concat(read.regex_escaped(F.lit(".(x)")), F.lit("$"))).alias("found"))
