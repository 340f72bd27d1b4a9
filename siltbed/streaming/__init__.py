"""siltbed.streaming"""
