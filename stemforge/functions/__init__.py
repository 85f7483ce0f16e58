"""Column expressions: text, arrays, morphology, etymology, geometry. All are JVM-side unless they say otherwise."""
