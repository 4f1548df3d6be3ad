"""strandlake: low-coverage genotype analytics as Spark plans."""
