"""Fixed values of the domain, as published."""

# Known binding motifs.
KNOWN_MOTIFS = {"HIM-8": "TTGGTCAGTGCA", "ZIM-1": "TTGGTCTGCTA", "ZIM-2": "TTGGGCGCTGCT", "ZIM-3": "TTGGTTGAGGCT"}
# Letters between TTGG and TG.
SPACERS = {"HIM-8": 4, "ZIM-1": 2, "ZIM-2": 4, "ZIM-3": 1}
# The protein that binds each chromosome.
CHROMOSOME_PARALOG = {"X": "HIM-8", "II": "ZIM-1", "III": "ZIM-1", "V": "ZIM-2", "I": "ZIM-3", "IV": "ZIM-3"}
MAIN_CHROMOSOMES = ["I", "II", "III", "IV", "V", "X"]
# Columns of GFF3 and of tabular hits.
GFF_COLUMNS = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]
HIT_COLUMNS = ["qseqid", "sseqid", "pident", "length", "qcovs", "bitscore", "evalue"]
# Shares of conserved residues that part the anchor's tiers.
CONSERVED, DIVERGED = 0.60, 0.40
# Patterns of a zinc finger, with the recognition helix as a group, and of a finger as a whole.
FINGER = r"C.{2,5}C(.{7,20}?)H.{2,6}H"
FINGER_GREEDY = r"C.{2,5}C.{7,20}H.{2,6}H"
