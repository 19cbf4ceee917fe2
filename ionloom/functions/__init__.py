"""ionloom.functions"""
