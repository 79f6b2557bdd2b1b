"""Operators of a training-data pipeline: tokens, duplicates, language, shards, packs and chats."""
