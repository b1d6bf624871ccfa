"""Training-data operators: chat formatting, HTML extraction, quality
rules, tokenisation, fingerprints, toxicity, near-duplicate joins, URL
filters, packing and secret scans.

One module per operator; ``queries`` registers them for the driver.
Nothing outside this package imports it.
"""
