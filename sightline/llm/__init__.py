"""Operators of a training-data pipeline: packing, decontamination, classifiers, chats, licences, URLs, dedup."""
