"""Column builders: pure expressions. Single INFO keys are regular expressions, within whole-stage code generation; what takes arrays apart (transform, filter, exists, aggregate) is evaluated row by row in the JVM."""
