"""Sequence kernels."""

from __future__ import annotations


def back_align(protein_alignment: str, dna: str) -> str:
    """The codons of ``dna`` under an aligned protein: three gaps for each gap; trailing codons go."""
    out, at = [], 0
    for c in protein_alignment:
        if c == "-":
            out.append("---")
        else:
            out.append(dna[at : at + 3])
            at += 3
    return "".join(out)


def coding_length_fits(protein: str, dna: str) -> bool:
    """A coding sequence holds its protein's codons and a stop."""
    return (len(protein) + 1) * 3 == len(dna)


def gene_name(number: int, strain: str, locus_tag: str, start: int, end: int) -> str:
    """``<number>_<strain>-<locus tag>``, or the coordinates where there is no tag."""
    return f"{number}_{strain}-{locus_tag}" if locus_tag else f"{number}_{strain}-{start}_{end}"


def distance_by_kmers(a: str, b: str, k: int = 4) -> float:
    """One minus the share of common k-mers: a plain stand-in where no aligner is installed."""
    x, y = ({s[i : i + k] for i in range(max(len(s) - k + 1, 1))} for s in (a, b))
    return 1 - len(x & y) / max(len(x | y), 1)
