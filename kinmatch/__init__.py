"""Record linkage on Spark: block, score and decode matches between an anchor table and two target tables."""
