"""Gene-name patterns that mark technical or ubiquitous genes."""

from __future__ import annotations

from pyspark.sql import Column

# Anchored, case-insensitive patterns that must equal the reference for right results.
NOISE_PATTERNS = (
    r"^M?RP[LSP]+[A-Z0-9]*\d+",
    r"^(?:EEF|EIF)\d[A-Z0-9]*",
    r"^PABP[CN]\d+.*",
    r"^(?:FAU|SUB1|OAZ[12])$",
    r"^MT-.*",
    r"^ATP\d+[A-Z0-9]*",
    r"^(?:NDUF|COX|UQCR)[A-Z0-9]+",
    r"^CHCHD\d+.*",
    r"^(?:TOMM|TIMM)\d+[A-Z0-9]*$",
    r"^(?:SLC25A[56]|VDAC1|CYCS)$",
    r"^(?:HSP|DNAJ)[A-Z0-9]+.*",
    r"^CCT\d+.*",
    r"^TRIM\d+.*",
    r"^PSM[ABCDE]\d+.*",
    r"^(?:CALR|PTGES3)$",
    r"^ACT[BG]\d*.*",
    r"^TUB[A-Z]+\d*.*",
    r"^MYL12[AB].*",
    r"^(?:FLNA|CLT[AB])$",
    r"^(?:ARPC\d[A-Z]?|ARF\d)$",
    r"^(?:CAP[12G]|CAPZ[AB]\d?|ANXA\d+)$",
    r"^(?:TMSB\d+[A-Z0-9]*|PTM[AS])$",
    r"^(?:SRSF[1-9]|NPM1|NCL|NOP\d+|NHP2|NACA)$",
    r"^HNRNP.*",
    r"^SNRP[A-Z0-9]+.*",
    r"^DDX\d+.*",
    r"^HIST[1-4].*",
    r"^H(?:[1-7]|2A|2B)[-A-Z0-9]+",
    r"^HMG[ABN]\d+$",
    r"^SEC[1236][1-9][A-Z0-9]*",
    r"^(?:SSR[1-4]|SPCS[1-3]|POMP)$",
    r"^RAN(?:BP\d+)?$",
    r"^RAB\d+[A-Z]*$",
    r"^RABAC1$",
    r"^(?:GAPDH|B2M|PPI[ABF]|PGK1|ENO1|ALDOC|UAP1|YWHA[ABHQZ])$",
    r"^(?:GDI|HINT|TPI|PNRC)\d+.*",
    r"^(?:PRDX|SOD)\d+$",
    r"^TXN(?:IP)?$",
    r"^(?:SH3BGRL\d*|CDV3|MIF|CALM\d+)$",
    r"^UB[ABC]\d*.*",
    r"^UBE2[A-Z\d]+$",
    r"^MT[0-9]+[A-Z].*",
    r"^[A-Z]{2}\d{5,}\.\d+",
    r"^(?:RP[1-9]\d*|CTD)-.*",
    r"^LINC\d+",
    r"^C[0-9XY]+orf\d+.*",
    r".*-AS\d*$",
    r"^MIR\d+.*",
    r"^(?:MALAT|NEAT|TSIX|XIST)\d*.*",
    r"^ZNF\d+",
    r"^(?:OR|TAS[12]R)\d+[A-Z]+\d+.*",
    r"^(?:SMCO|KIR|PRSS|FAM)\d+[A-Z]*",
    r"^(?:KIAA|NPIPB)\d+.*",
    r"^KRT(?:2[1-9]|[3-9]\d|[1-9]\d{2,}).*",
    r"^HLA-[ABC].*",
    r"^(?:FOS(?:B|L\d)?|JUN[BD]?|EGR\d+.*|IER\d+.*|BTG\d+.*|ZFP36.*|DUSP\d+.*)$",
    r"^(?:CIRBP|RACK1|SFPQ|RBM39|YBX\d+.*)$",
    r"^(?:CFL\d+.*|PFN\d+.*|MYL6|AHNAK.*)$",
)

NOISE_REGEX = "(?i)" + "|".join(NOISE_PATTERNS)


def is_noise(gene: Column) -> Column:
    return gene.rlike(NOISE_REGEX)
