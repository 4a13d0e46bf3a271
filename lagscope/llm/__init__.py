"""Training-data operators: license scans, WARC archives, language
identification, near and exact de-duplication, line cleaning, source mixing,
chat formatting, token counts and BPE, each as a Spark job.

The rest of the library never imports this subpackage.
"""
