"""Column functions: text, ids, vectors and scores, all inside the JVM but where the docstring says otherwise."""
