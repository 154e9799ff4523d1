"""strataq.streaming"""
