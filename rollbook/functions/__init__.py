"""Column expressions: predicates, order, rendering, tokens and signatures."""
