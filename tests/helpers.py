"""Builders of invoice rows and of small files in the formats that are read."""

import io
import zipfile
import zlib

from tallyworks import schema


def invoice(id_=1, **over):
    """An invoice row as a dict; a field is a value (from XML) or (value, source, confidence)."""
    blank = {"value": None, "confidence": 0.0, "source": "missing"}
    out = {f.name: (dict(blank) if f.dataType in (schema.TEXT_FIELD, schema.MONEY_FIELD) else None) for f in schema.INVOICE}
    out |= {"id": id_, "items": [], "issues": [], "source_path": f"p{id_}", "file_hash": f"h{id_}"}
    for k, v in over.items():
        if k == "items":
            out["items"] = [{**{f.name: None for f in schema.ITEM}, "name": n} for n in v]
        elif isinstance(out.get(k), dict):
            value, source, confidence = v if isinstance(v, tuple) else (v, "xml", 1.0)
            out[k] = {"value": value, "confidence": confidence, "source": source}
        else:
            out[k] = v
    return out


def xml(number="24312000000000009999", seller="海风餐饮店", item="*餐饮服务*餐费", net="200.00", tax="12.00", total="212.00", date="2024-02-03", encoding="UTF-8"):
    text = f"""<?xml version="1.0" encoding="{encoding}"?>
<e:EInvoice xmlns:e="urn:x"><Header><InvoiceNumber>{number}</InvoiceNumber><IssueTime>{date}T08:00:00</IssueTime></Header>
<SellerInformation><SellerName>{seller}</SellerName><SellerTaxID>91X</SellerTaxID></SellerInformation><Buyer><BuyerName>山海公司</BuyerName></Buyer>
<BasicInformation><TotalAmWithoutTax>{net}</TotalAmWithoutTax><TotalTaxAm>{tax}</TotalTaxAm><TotalTax-includedAmount>{total}</TotalTax-includedAmount></BasicInformation>
<IssuItemInformation><ItemName>{item}</ItemName><Amount>{net}</Amount><TaxRateValue>6%</TaxRateValue><ComTaxAm>{tax}</ComTaxAm></IssuItemInformation>
<IssuItemInformation><ItemName>*餐饮服务*茶</ItemName><Quantity>2</Quantity></IssuItemInformation><Remark>午餐</Remark></e:EInvoice>"""
    return text.encode("gb18030" if encoding.lower().startswith("gb") else "utf-8")


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


def ofd(pages, extra=None):
    page = lambda runs: "<ofd:Page xmlns:ofd='u'>" + "".join(f"<ofd:TextObject><ofd:TextCode X='1'>{r}</ofd:TextCode></ofd:TextObject>" for r in runs) + "</ofd:Page>"
    return archive({"OFD.xml": "<ofd:OFD xmlns:ofd='u'/>", **{f"Doc_0/Pages/Page_{n}/Content.xml": page(r) for n, r in pages.items()}, **(extra or {})})


def pdf(text=None, attachment=None, image=None):
    """A PDF of one page with lines of text (shown through a ToUnicode map), an attached file and an image."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R" + (b" /Names << /EmbeddedFiles << /Names [(a.xml) 8 0 R] >> >>" if attachment else b"") + b" >>"}
    objects[2] = b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>"
    resources = b"/Font << /F1 5 0 R >>" + (b" /XObject << /I 10 0 R >>" if image else b"")
    objects[3] = b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << " + resources + b" >> >>"

    def stream(info, data, deflate=True):
        data = zlib.compress(data) if deflate else data
        return b"<< " + info + (b" /Filter /FlateDecode" if deflate else b"") + b" /Length " + str(len(data)).encode() + b" >>\nstream\n" + data + b"\nendstream"

    chars = sorted(set("".join(text or ())))
    code = {c: f"{k + 1:04X}" for k, c in enumerate(chars)}
    body = "BT /F1 12 Tf " + " ".join(f"<{''.join(code[c] for c in line)}> Tj 0 -14 Td" for line in text or ()) + " ET"
    objects[4] = stream(b"", body.encode())
    objects[5] = b"<< /Type /Font /Subtype /Type0 /ToUnicode 6 0 R >>"
    objects[6] = stream(b"", ("1 beginbfchar " * bool(chars) + " ".join(f"<{code[c]}> <{c.encode('utf-16-be').hex()}>" for c in chars) + " endbfchar").encode())
    if attachment:
        objects[8] = b"<< /Type /Filespec /EF << /F 9 0 R >> >>"
        objects[9] = stream(b"/Type /EmbeddedFile", attachment)
    if image:
        w, h, data = image
        objects[10] = stream(b"/Type /XObject /Subtype /Image /BitsPerComponent 8 /Width %d /Height %d" % (w, h), data)
    return b"%PDF-1.7\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"
