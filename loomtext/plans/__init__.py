"""Query languages and their lowering to DataFrame plans."""
