"""License scans (native): sentences to identifiers, identifiers to licences by ordered rules.

A text is cut into pieces at line ends and after stops (not colons), each piece
normalised (case, punctuation and spacing do not matter).  A known licence sentence
is a piece, or consecutive pieces: a notice wrapped at any width, behind comment
signs or over blank lines, and a sentence with a stop inside ("v. 2.0") are found
whole.  From left to right, a piece that is a sentence by itself is taken first, then
the longest sentence that begins there.  A piece that begins with "copyright" and one
that names an SPDX identifier are known by their form.  The identifiers, in the order
of the text, are matched against the rules from first to last: where a rule's
identifiers stand one after the other they are taken and the rule's licence is
found; later rules see what is left.  ``n_sentences`` counts pieces.  The SQL
(``oracle``) looks up single pieces only, so it finds less where a sentence is wrapped.

All of it happens inside a document's row: no shuffle, and neither a hot source
nor a notice that a third of all documents carry meets in one place.

Defined results: null, empty or licence-free text has no identifiers and no
licences; a licence is named once a document, in order of rule; a null
``doc_id`` and repeated rows are returned as they stand; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlens.llm._text import ascii_lower, read
from pitchlens.llm.licenses import RULES, dictionary

#: Where a piece ends: at a line end, or at white space after a stop.
END = r"\n+|[.!?;][ \t]+"
SPDX = "spdx license identifier "
#: Between identifiers; rules never cross it.
TAKEN = "|"


def sentences(text: Column) -> Column:
    """Normalised pieces of a text, the empty ones left out."""
    cut = F.split(ascii_lower(F.coalesce(text, F.lit(""))), END)
    return F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))), lambda s: s != "")


def pattern() -> str:
    """What is known, in pieces with a line end between: a whole piece, a form, or a sentence over several pieces, longest first."""
    whole = sorted(dictionary(), key=len, reverse=True)
    over = [s.replace(" ", "[ \\n]") for s in whole]
    return f"(?md)^(?:(?:{'|'.join(whole)})$|(?:copyright |{SPDX})[^\\n]*$|(?:{'|'.join(over)})$)"


def identifiers(pieces: Column) -> Column:
    """An identifier for each known sentence of an array of pieces, in its order."""
    known = dictionary()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    found = F.regexp_extract_all(F.array_join(pieces, "\n"), F.lit(pattern()), F.lit(0))
    name = lambda s: (F.when(s.isin(list(known)), F.element_at(table, s))
                      .when(s.startswith("copyright "), F.lit("COPYRIGHT"))
                      .when(s.startswith(SPDX), F.concat(F.lit("SPDX:"), F.replace(F.substr(s, F.lit(len(SPDX) + 1)), F.lit(" "), F.lit("-")))))
    return F.transform(F.transform(found, lambda s: F.replace(s, F.lit("\n"), F.lit(" "))), name)


def _match(ids: Column) -> Column:
    """struct(left, licences): the rules over identifiers, folded from first to last."""
    rules = F.array(*[F.struct(F.lit(",".join(["", *seq, ""])).alias("seq"), F.lit(name).alias("name")) for name, seq in RULES])
    line = F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))
    rules = F.transform(rules, lambda r: F.struct(F.replace(r["seq"], F.lit(","), F.lit(",,")).alias("seq"), r["name"].alias("name")))
    start = F.struct(line.alias("left"), F.array().cast("array<string>").alias("licences"))

    def step(acc: Column, r: Column) -> Column:
        seq = F.substr(r["seq"], F.lit(2), F.length(r["seq"]) - 2)
        return F.when(F.contains(acc["left"], seq), F.struct(F.replace(acc["left"], seq, F.lit(TAKEN)).alias("left"),
                      F.concat(acc["licences"], F.array(r["name"])).alias("licences"))).otherwise(acc)

    return F.aggregate(rules, start, step)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, n_sentences, identifiers (array), licences (array): a row for each row of ``documents``."""
    rows = documents.select("doc_id", sentences(F.col("text")).alias("s"))
    rows = rows.select("doc_id", F.size("s").cast("long").alias("n_sentences"), identifiers(F.col("s")).alias("identifiers"))
    none = F.array().cast("array<string>")
    spdx = F.transform(F.filter("identifiers", lambda x: x.startswith("SPDX:")), lambda x: F.substr(x, F.lit(6)))
    by_rule = F.when(F.size("identifiers") > 0, _match(F.col("identifiers"))["licences"]).otherwise(none)
    return rows.select("doc_id", "n_sentences", "identifiers", F.array_distinct(F.concat(by_rule, spdx)).alias("licences"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    out = scan(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_sentences", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"))


def oracle() -> str:
    """The same in SQL: sentences by position, identifiers by a join, rules as one replacement after the other."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({q(s)}, {q(i)})" for s, i in dictionary().items())
    steps, last = [], "i"
    for k, (_, seq) in enumerate(RULES):
        want = q("," + ",,".join(seq) + ",")
        carried = "".join(f", f{j}" for j in range(k))
        steps.append(f"r{k} AS (SELECT r, replace(line, {want}, '|') AS line, contains(line, {want}) AS f{k}{carried} FROM {last})")
        last = f"r{k}"
    named = "list_filter([" + ", ".join(f"CASE WHEN f{k} THEN {q(n)} END" for k, (n, _) in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k(s, id) AS (VALUES {known}),
c AS (SELECT r, regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\\n+|[.!?;][ \\t]+') AS cut FROM d),
p AS (SELECT r, unnest(cut) AS s, generate_subscripts(cut, 1) AS pos FROM c),
s AS (SELECT r, pos, trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'), ' ') AS s FROM p),
n AS (SELECT r, count(*) FILTER (s <> '') AS n FROM s GROUP BY r),
f AS (SELECT r, pos, CASE WHEN k.id IS NOT NULL THEN k.id WHEN starts_with(s.s, 'copyright ') THEN 'COPYRIGHT'
  WHEN starts_with(s.s, '{SPDX}') THEN 'SPDX:' || replace(substr(s.s, {len(SPDX) + 1}), ' ', '-') END AS id FROM s LEFT JOIN k USING (s)),
i AS (SELECT r, ',' || string_agg(id, ',,' ORDER BY pos) || ',' AS line FROM f WHERE id IS NOT NULL GROUP BY r),
{", ".join(steps)},
x AS (SELECT r, string_agg(id, ',' ORDER BY pos) AS ids, list(substr(id, 6) ORDER BY pos) FILTER (starts_with(id, 'SPDX:')) AS spdx FROM f WHERE id IS NOT NULL GROUP BY r),
l AS (SELECT r, list_concat({named}, coalesce(spdx, [])) AS names FROM {last} JOIN x USING (r)),
u AS (SELECT r, string_agg(name, ',' ORDER BY pos) AS licences FROM (SELECT r, name, min(pos) AS pos FROM (SELECT r, unnest(names) AS name, generate_subscripts(names, 1) AS pos FROM l) GROUP BY r, name) GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS identifiers, coalesce(licences, '') AS licences
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r) LEFT JOIN u USING (r)
"""
