"""Column-expression helpers and the few numeric functions Spark lacks."""
