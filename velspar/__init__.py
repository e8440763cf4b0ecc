"""Mixed-model analytics over genotype tables, as Spark jobs.

Genotypes are a long table geno (s, v, g): sample, variant, dosage 0, 1 or 2, null or absent if missing. Products with the
standardised genotype matrix Z are joins and grouped sums over it; vectors over samples or variants are tables too.
"""
