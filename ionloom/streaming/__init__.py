"""ionloom.streaming"""
