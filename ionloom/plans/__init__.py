"""ionloom.plans"""
