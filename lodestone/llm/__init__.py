"""Training-data operators: near copies, fingerprints, language, tokens, rules, chat, toxicity, mixing.

Nothing else in the library imports this subpackage.
"""
