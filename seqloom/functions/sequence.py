"""Scalar functions on symbol sequences, motifs and headers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


#: Printable ASCII but for lower case, and what each sign is on the opposite strand.
_SIGNS = "".join(chr(i) for i in range(32, 127) if not 97 <= i <= 122)
_OPPOSITE = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}.get(c, "N") for c in _SIGNS)


def reverse_complement(s: Column) -> Column:
    """Reverse complement in upper case; anything but A, C, G and T becomes N. ASCII takes one table look-up a letter."""
    plain = F.translate(F.reverse(F.upper(s)), _SIGNS, _OPPOSITE)
    other = F.translate(F.reverse(F.regexp_replace(F.upper(s), "[^ACGT]", "N")), "ACGT", "TGCA")
    return F.when(F.octet_length(s) == F.length(s), plain).otherwise(other)


def canonical_kmer(k: Column) -> Column:
    """The lesser of a k-mer and its reverse complement."""
    return F.least(k, reverse_complement(k))


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def hamming(a: Column, b: Column) -> Column:
    """Places that differ, over the shorter length."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(F.split(F.substring(a, F.lit(1), n), ""), F.split(F.substring(b, F.lit(1), n), ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def hamming_first(a: Column, b: Column, n: int) -> Column:
    """Places that differ among the first n, over the shorter length; a sum of comparisons, within codegen."""
    out = F.lit(0)
    for i in range(n):
        out = out + ((F.length(a) > i) & (F.length(b) > i) & (F.substring(a, i + 1, 1) != F.substring(b, i + 1, 1))).cast("int")
    return out


def hamming_to(a: Column, word: str) -> Column:
    """Places of a that differ from a fixed word, over the shorter length; a sum of comparisons, within codegen."""
    out = F.lit(0)
    for i, c in enumerate(word):
        out = out + ((F.length(a) > i) & (F.substring(a, i + 1, 1) != c)).cast("int")
    return out


def orient(kmer: Column, anchor: str = "TTGG") -> Column:
    """The k-mer or its reverse complement, whichever starts with the anchor (the k-mer first); else null."""
    rc = reverse_complement(kmer)
    return F.when(kmer.startswith(anchor), kmer).when(rc.startswith(anchor), rc)


def starts_either_strand(kmer: Column, anchor: str = "TTGG") -> Column:
    back = anchor.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return kmer.startswith(anchor) | kmer.endswith(back)


def framework_spacer(motif: Column, least: int = 1, most: int = 4, second: str = "TG", anchor_len: int = 4) -> Column:
    """The smallest number of letters between the anchor's place and the second anchor; the anchor itself is not tested."""
    out = None
    for s in range(least, most + 1):
        test = F.substring(motif, anchor_len + s + 1, len(second)) == second
        out = F.when(test, s) if out is None else out.when(test, s)
    return out.cast("int")


def low_complexity(motif: Column, units: tuple = (2, 3, 4, 6)) -> Column:
    """A whole number of repeats of a unit of these lengths, or at most two different letters."""
    n = F.length(motif)
    out = F.size(F.array_distinct(letters(motif))) <= 2
    for u in units:
        out = out | ((n % u == 0) & (n > 0) & (motif == F.repeat(F.substring(motif, 1, u), F.floor(n / u).cast("int"))))
    return out


def motif_columns(motif: Column, pseudocount: float = 0.01) -> Column:
    """Position weights of a motif: array of structs a, c, g, t; an unknown letter gives 0.25 each."""
    total = 1 + 4 * pseudocount
    hit, miss = (1 + pseudocount) / total, pseudocount / total

    def column(x):
        known = x.isin(*BASES)
        return F.struct(*[F.when(~known, 0.25).when(x == b, hit).otherwise(miss).alias(b.lower()) for b in BASES])

    return F.transform(letters(F.upper(motif)), column)


def framework_columns(length: int, anchor: str = "TTGG", pseudocount: float = 0.01) -> list[tuple]:
    """Weights of a motif of which only the anchor is known."""
    total = 1 + 4 * pseudocount
    row = lambda c: tuple(((1 if b == c else 0) + pseudocount) / total for b in BASES)
    return [row(anchor[i]) if i < len(anchor) else (0.25,) * 4 for i in range(length)]


def motif_frame(spacer: int, length: int) -> dict[str, list[int]]:
    """Places of the anchor, the spacer, the second anchor and the tail."""
    return {"anchor": list(range(4)), "spacer": list(range(4, 4 + spacer)), "second": [4 + spacer, 5 + spacer], "tail": list(range(6 + spacer, length))}


def is_anchor(pos: Column, spacer: Column) -> Column:
    return (pos < 4) | (pos == spacer + 4) | (pos == spacer + 5)


def information(*p: Column) -> Column:
    """Bits of a column of weights: 2 + sum of p log2 p, with 0 log 0 = 0."""
    out = F.lit(2.0)
    for x in p:
        out = out + F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    return out


def column_distance(p: list[Column], q: list[Column], metric: str = "euclidean") -> Column:
    """Distance of two columns: Euclidean, or the Jensen-Shannon divergence to the base 2 (without a root)."""
    if metric == "euclidean":
        return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(p, q)), F.lit(0.0)))
    if metric == "jsd":
        kl = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
        return sum(((kl(a, (a + b) / 2) + kl(b, (a + b) / 2)) / 2 for a, b in zip(p, q)), F.lit(0.0))
    raise ValueError(f"unknown metric: {metric}")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_vector(rows: Column, dim: int) -> Column:
    """Mean of an array of vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(rows, F.lit(0.0), lambda acc, v: acc + F.get(v, i).cast("double")) / F.size(rows))


def softmax(z: Column) -> Column:
    top = F.array_max(z)
    e = F.transform(z, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda acc, y: acc + y))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def header_id(header: Column) -> Column:
    return F.split(F.trim(header), r"\s+")[0]


def header_fields(header: Column) -> Column:
    """Map of the k=v words after the first, cut at the first =; words without = are dropped and the last of a key wins.
    The first word is under ``id``."""
    words = F.split(F.trim(header), r"\s+")
    pairs = F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.contains(w, F.lit("=")))
    entries = F.transform(pairs, lambda w: F.struct(F.substring_index(w, "=", 1).alias("k"), F.substring(w, F.instr(w, "=") + 1, F.length(w)).alias("v")))
    keys = F.transform(entries, lambda e: e["k"])
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys) - i - 1, F.lit(0))), e["k"]))
    return F.map_concat(F.create_map(F.lit("id"), words[0]), F.map_from_entries(F.filter(last, lambda e: e["k"] != "id")))


def gene_id(attributes: Column) -> Column:
    """Value of the first part that starts with ID=, Name= or gene_id=, without quotes; null without one."""
    found = F.regexp_extract(attributes, r"(?:^|;)\s*(?:ID|Name|gene_id)=([^=;]*)", 1)
    return F.when(F.regexp_like(attributes, F.lit(r"(?:^|;)\s*(?:ID|Name|gene_id)=")), F.btrim(found, F.lit('"')))


def gff_attribute(attributes: Column, key: str, value: str = "[^;]+") -> Column:
    return F.regexp_extract(attributes, rf"(?:^|;){key}=({value})", 1)


def names_any(text: Column, terms: list[str]) -> Column:
    """Whether any term occurs, whatever the case; null text holds none."""
    return F.coalesce(F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(text), t)), F.lit(False))


def matches_any(text: Column, terms: list[str]) -> Column:
    """Whether any term matches as a pattern, whatever the case; null text matches none."""
    return F.coalesce(F.regexp_like(text, F.lit("(?i)" + "|".join(terms))), F.lit(False))


def n_share(s: Column, window: int, side: str = "left") -> Column:
    """Share of N among the first or last ``window`` letters; the divisor is the nominal window."""
    part = F.substring(s, F.lit(1), F.lit(window)) if side == "left" else F.right(s, F.lit(window))
    return (F.length(part) - F.length(F.replace(part, F.lit("N"), F.lit("")))) / F.lit(float(window))


def confidence(bits: Column, period: Column, from_end_kb: Column, specific: Column) -> Column:
    """Tier of a single run."""
    tandem = F.coalesce(period.between(20, 3000), F.lit(False))
    return F.when((bits >= 6) & tandem & (from_end_kb <= 1500) & F.coalesce(specific, F.lit(False)), "HIGH").when((bits >= 3.5) & tandem, "MEDIUM").otherwise("LOW")


def reconciled_tier(bits: Column, period: Column, reproduced: Column, from_end_kb: Column) -> Column:
    """Tier of a motif seen in two runs."""
    defined = (bits >= 6) & F.coalesce((period != 0) & period.between(20, 3000), F.lit(False))
    near = from_end_kb <= 1500
    return F.when(defined & reproduced & near, "HIGH").when(defined & (reproduced | near), "MEDIUM").otherwise("LOW")


def tandem(spacing: Column) -> Column:
    return F.coalesce(spacing.between(15, 5000), F.lit(False))


def tier_order(tier: Column) -> Column:
    return F.when(tier == "HIGH", 0).when(tier == "MEDIUM", 1).otherwise(2)


def top_hits_text(ids: Column, percents: Column, n: int = 3) -> Column:
    """``id(p%); id(p%)`` of the first n hits."""
    parts = F.transform(F.arrays_zip(ids.alias("i"), percents.alias("p")), lambda x: F.concat(x["i"], F.lit("("), F.round(x["p"]).cast("int").cast("string"), F.lit("%)")))
    return F.array_join(F.slice(parts, 1, n), "; ")


def tip_label(species: Column, name: Column) -> Column:
    """Label of a sequence in a tree: species, then the name in lower case."""
    return F.concat(species, F.lit("_"), F.lower(name))


def support_text(count: Column, replicates: int) -> Column:
    """``n/replicates``, or that a clade was not found."""
    return F.when(count.isNull(), "not recovered").otherwise(F.format_string(f"%d/{replicates}", count))
