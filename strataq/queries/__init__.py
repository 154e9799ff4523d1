"""strataq.queries"""
